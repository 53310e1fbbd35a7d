r"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns.  Prefix sums of turn tokens
choose the spans: a turn belongs to the span in which its tokens begin, spans
being ``stride`` tokens long, and a turn longer than that is a span of its own.
So the new turns of a window have under ``2 * stride = budget - history``
tokens, unless it is one long turn.  A window that doesn't begin the conversation
first repeats its system turn, then up to ``HISTORY_TURNS`` turns before the
span, as long as these have ``history`` tokens at most and the whole window
stays within ``budget``: what doesn't fit into that is left out whole.  So
only a single turn longer than the budget exceeds it, and nothing stands beside
it.  Loss falls on assistant turns, each in the one window where it is new:
repeated targets are masked.

The template is ``<turn N ROLE>TEXT</turn>`` and a line feed, ``<again N ROLE>``
for repeated turns.  In texts ``\`` becomes ``\b`` and ``<`` becomes ``\l`` (in
roles also ``>`` becomes ``\g``), so no control string can occur in a text, and
the escapes are undone exactly by reading them backwards.

Prefix sums are taken in two levels, over chunks of turn numbers, and history
is joined by turn number, so a conversation of any length is spread over tasks.
Only DataFrame functions are used.

Defined results: null texts and roles are empty; turns go by number, null last,
then role, then text, repeated rows being turns of their own; a null conv_id is
a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, staged
from .mixing import word_count

#: Tokens of a window, repeated turns among them; of these, for history; turns repeated at most; tokens of a turn's marks.
BUDGET, HISTORY, HISTORY_TURNS, MARKS = 1024, 256, 2, 4
#: Turn numbers in a chunk.
CHUNK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def numbered(turns: DataFrame, stride: int) -> DataFrame:
    """key, idx, role, text, tokens, and the span: seg, cell."""
    t = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("tokens", word_count(F.col("text")) + MARKS)
    t = t.withColumn("long", (F.col("tokens") > stride).cast("long")).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(2**62)))
    w = Window.partitionBy("key", "chunk").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = t.withColumn("i", F.row_number().over(w) - 1).withColumn("p", F.sum("tokens").over(upto) - F.col("tokens")).withColumn("l", F.sum("long").over(upto) - F.col("long"))
    totals = t.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"), F.sum("long").alias("m"))
    before = offsets(totals, ["key"], "chunk", {"n": "n0", "s": "s0", "m": "m0"})
    j = inner.join(before, ["key", "chunk"])
    return j.select(
        "key",
        (F.col("i") + F.col("n0")).alias("idx"),
        "role",
        "text",
        "tokens",
        ((F.col("l") + F.col("m0")) * 2 + F.col("long")).alias("seg"),
        F.when(F.col("long") == 1, F.lit(0)).otherwise(F.floor((F.col("p") + F.col("s0")) / stride)).alias("cell"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, first (its first new turn), text, loss (array of start and length in characters), new_tokens, tokens (of all its turns).

    ``turns`` has conv_id, turn, role and text.
    """
    stride = max(1, (budget - history) // 2)
    t = staged(numbered(turns, stride), "turns")
    span = ["key", "seg", "cell"]
    # what the new turns leave of the budget goes to the system turn first
    heads = t.groupBy(*span).agg(F.min("idx").alias("first"), F.sum("tokens").alias("own")).filter("first > 0").select(*span, "first", (F.lit(budget) - F.col("own")).alias("room"))
    old = t.select("key", F.col("idx").alias("at"), F.col("role").alias("r"), F.col("text").alias("x"), F.col("tokens").alias("t"))
    system = old.filter("at = 0 AND r = 'system'").drop("at", "r")
    heads = heads.join(system, "key", "left").withColumn("retained", F.coalesce(F.col("t") <= F.col("room"), F.lit(False)))
    heads = heads.withColumn("x", F.when(F.col("retained"), F.col("x")))
    heads = staged(heads.withColumn("room", F.when(F.col("retained"), F.col("room") - F.col("t")).otherwise(F.col("room"))), "heads")
    retained = heads.filter("retained").select(*span, F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("idx"), F.lit("system").alias("role"), F.col("x").alias("text"), F.col("t").alias("tokens"))
    back = heads.select(*span, "first", "room", F.explode(F.sequence(F.lit(1), F.lit(HISTORY_TURNS))).alias("back")).withColumn("at", F.col("first") - F.col("back"))
    back = back.join(old, ["key", "at"]).filter("NOT (at = 0 AND r = 'system')")
    so_far = Window.partitionBy(*span).orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    back = back.withColumn("used", F.sum("t").over(so_far)).filter(F.col("used") <= F.least(F.lit(history), F.col("room")))
    piece = lambda mark: F.concat(F.lit(f"<{mark} "), F.col("idx").cast("string"), F.lit(" "), escape_role(F.col("role")), F.lit(">"))
    new = t.select(*span, F.col("idx").alias("ord"), F.lit(False).alias("again"), "idx", "role", "text", "tokens")
    again = retained.select(*span, "ord", F.lit(True).alias("again"), "idx", "role", "text", "tokens").unionByName(
        back.select(*span, F.col("at").alias("ord"), F.lit(True).alias("again"), F.col("at").alias("idx"), F.col("r").alias("role"), F.col("x").alias("text"), F.col("t").alias("tokens"))
    )
    pieces = new.unionByName(again)
    pieces = pieces.withColumn("head", F.when(F.col("again"), piece("again")).otherwise(piece("turn"))).withColumn("body", escape(F.col("text")))
    pieces = pieces.select(
        *span, F.struct("ord", "again", "idx", F.concat("head", "body", F.lit("</turn>\n")).alias("s"), F.length("head").alias("h"), F.length("body").alias("b"), (~F.col("again") & (F.col("role") == "assistant")).alias("target")).alias("p"), "again", "idx", "tokens"
    )
    w = pieces.groupBy(*span).agg(F.array_sort(F.collect_list("p")).alias("ps"), F.min(F.when(~F.col("again"), F.col("idx"))).alias("first"), F.sum(F.when(F.col("again"), 0).otherwise(F.col("tokens"))).alias("new_tokens"), F.sum("tokens").alias("tokens"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["s"])).alias("at"),
        F.when(p["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return w.select(
        F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id"),
        "first",
        F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("text"),
        F.aggregate("ps", zero, step, lambda a: a["spans"]).alias("loss"),
        "new_tokens",
        "tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, first, turns (array of role and text, new ones only), targets (array of texts under the loss mask), chars; from text and loss alone."""
    parts = F.slice(F.split("text", "<turn "), 2, 1 << 30)
    parsed = F.transform(
        parts,
        lambda e: F.struct(
            unescape_role(F.substr(F.substring_index(e, ">", 1), F.instr(e, " ") + 1)).alias("role"),
            unescape(F.substring_index(F.substr(e, F.length(F.substring_index(e, ">", 1)) + 2), "</turn>", 1)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "first", parsed.alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))


# -- registered query -----------------------------------------------------------

#: A conversation whose texts hold escapes, another template's marks and this one's.
TRAP = "\\### Assistant: </turn> ok"


def op6_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    back = read_back(windows(turns.unionByName(trap)))
    back = back.select(
        "conv_id",
        "first",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"),
        "chars",
    )
    # a digest of a whole conversation needs its text in one place; windows have joined its turns before that
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first", "turns", "loss"))).alias("ws"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    sha = lambda field: F.sha2(F.array_join(F.transform("ws", lambda w: w[field]), "").cast("binary"), 256)
    return whole.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), "loss_chars", sha("loss").alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 4 AS tokens FROM c
), n AS (
  SELECT *, row_number() OVER o - 1 AS idx, sum(tokens) OVER o - tokens AS p, sum(CASE WHEN tokens > 384 THEN 1 ELSE 0 END) OVER o - CASE WHEN tokens > 384 THEN 1 ELSE 0 END AS l
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, l * 2 + CASE WHEN tokens > 384 THEN 1 ELSE 0 END AS seg, CASE WHEN tokens > 384 THEN 0 ELSE floor(p / 384) END AS cell,
         length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
         + length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', ''))
         + length(CAST(idx AS VARCHAR)) AS own
  FROM n
), g AS (
  SELECT conv_id, seg, cell, min(idx) AS first, 1024 - sum(tokens) AS room FROM s GROUP BY ALL HAVING min(idx) > 0
), h AS (
  SELECT g.*, y.own AS system_own, room - coalesce(y.tokens, 0) AS rest FROM g LEFT JOIN s y ON y.conv_id = g.conv_id AND y.idx = 0 AND y.role = 'system' AND y.tokens <= g.room
), again AS (
  SELECT conv_id, system_own AS own FROM h WHERE system_own IS NOT NULL
  UNION ALL
  SELECT h.conv_id, a.own FROM h JOIN s a ON a.conv_id = h.conv_id AND a.idx = h.first - 1 AND NOT (a.idx = 0 AND a.role = 'system') AND a.tokens <= least(256, rest)
  UNION ALL
  SELECT h.conv_id, b.own FROM h JOIN s a ON a.conv_id = h.conv_id AND a.idx = h.first - 1 JOIN s b ON b.conv_id = h.conv_id AND b.idx = h.first - 2
  WHERE NOT (b.idx = 0 AND b.role = 'system') AND a.tokens + b.tokens <= least(256, rest)
), extra AS (
  SELECT conv_id, sum(own + 17) AS chars FROM again GROUP BY conv_id
)
SELECT s.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(own + 16) + coalesce(max(extra.chars), 0) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN extra ON extra.conv_id = s.conv_id GROUP BY s.conv_id
"""
