"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes there is exactly one token that can come
last in the prefix's encoding: of the tokens that end there, the one that
follows validly on the last token of the prefix before it.  A pair follows
validly if the merges, applied to its bytes alone, give that pair back.  So
one array of last tokens holds the encodings of all prefixes: appending bytes
only adds entries, and after an edit only entries near it change.  The tokens
that end in a prefix come from an automaton over all tokens, one step a byte.

Texts are cut into pieces by the tokenizer's pattern.  The distinct pieces of
a slice of texts are encoded together, all their prefixes of one length at a
time, by array operations, and their ids dealt out to the places where they
stand.  Between slices a worker keeps the vocabulary, with its automaton and
a table of fixed size of which pairs follow validly.

Defined results: null and empty texts have no ids; lone rows, repeated rows
and null doc_ids are encoded like any other; an empty table gives an empty
result.  The vocabulary's path is a parameter; the driver reads it, workers
get its bytes (about a megabyte, whatever the data).
"""

from __future__ import annotations

import base64
import hashlib
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, ship, slices, text_bytes

#: White space as tokenizer patterns mean it: the Unicode property White_Space (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bytes of text encoded at once, and chunks or pieces dealt out or encoded at once.
SLICE, BLOCK = 1 << 20, 1 << 18
#: Pairs of tokens known at most (a power of two), and how many pieces of a slice, the longest ones, are encoded one by one.
PAIRS, FEW = 1 << 18, 32
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Table:
    """Whole numbers from 0 to whole numbers, looked up many at once; -1 for those that it lacks."""

    def __init__(self, items: dict[int, int]):
        keys = np.fromiter(items, np.int64, len(items))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        values, at = np.fromiter(items.values(), np.int32, len(items)), self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        held = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero(held != keys)
        out[todo] = -1
        todo = todo[held[todo] >= 0]
        while len(todo):
            at[todo] = near = (at[todo] + 1) & self.mask
            held = self.keys[near]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[near[hit]]
            todo = todo[~hit & (held >= 0)]
        return out


class Vocabulary:
    """Token bytes and ids, and which pairs of tokens may stand side by side."""

    def __init__(self, raw: bytes):
        self.ids: dict[bytes, int] = {}
        for line in raw.splitlines():
            if line:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.longest = max(map(len, self.ids), default=1)
        top = max(self.ids.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * top
        for token, i in self.ids.items():
            self.bytes[i] = token
        self._size = max(top, 1)
        #: For each token of several bytes, the two tokens whose merge makes it.
        self.left, self.right = [-1] * top, [-1] * top
        self._joins: dict[int, int] = {}
        self.apart = lru_cache(PAIRS // 4)(self._apart)
        for token in sorted(i for t, i in self.ids.items() if len(t) > 1):
            data = self.bytes[token]
            for cut in range(1, len(data)):
                l, r = self.ids.get(data[:cut], top), self.ids.get(data[cut:], top)
                if l < token and r < token and self._apart(l, r):
                    self.left[token], self.right[token] = l, r
                    self._joins[l * self._size + r] = token
                    break

        self._automaton()
        self._arrays()

    def _automaton(self) -> None:
        """States are the beginnings of tokens: the longest that the bytes so far end with.  ``inside`` has the steps
        that stay in a token, ``fall`` the next shorter state that a state ends with, ``top`` the longest state that a
        state ends with (itself too) and that is a token, ``token`` that token."""
        self.inside: dict[int, int] = {}
        place = {b"": 0}
        for token in sorted(self.ids, key=len):
            state = 0
            for end, byte in enumerate(token, 1):
                key = state << 8 | byte
                state = self.inside.get(key)
                if state is None:
                    state = self.inside[key] = place[token[:end]] = len(place)
        self.fall, self.top, self.token = [0] * len(place), [0] * len(place), [-1] * len(place)
        for data, state in sorted(place.items(), key=lambda x: len(x[0])):
            if data:
                fall = self.fall[state] = next((place[data[cut:]] for cut in range(1, len(data)) if data[cut:] in place), 0)
                self.token[state] = self.ids.get(data, -1)
                self.top[state] = self.top[fall] if self.token[state] < 0 else state

    def _arrays(self) -> None:
        """The same for many prefixes at once."""
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.lefts, self.rights = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.falls, self.tops, self.tokens_at = (np.array(x, np.int64) for x in (self.fall, self.top, self.token))
        self.hops, self.merges = Table(self.inside), Table(self._joins)
        self.pairs = np.full(PAIRS, -1, np.int64)

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix, from the front: of the tokens that end there, longest first, the one that
        follows validly on the last token before it."""
        inside, fall, top, token, bytes_, apart = self.inside.get, self.fall, self.top, self.token, self.bytes, self.apart
        last: list[int] = []
        state = 0
        for end, byte in enumerate(data):
            after = inside(state << 8 | byte)
            while after is None and state:
                state = fall[state]
                after = inside(state << 8 | byte)
            state = after or 0
            at = top[state]
            while at:
                start = end - len(bytes_[token[at]])
                if start < 0 or apart(last[start], token[at]):
                    break
                at = top[fall[at]]
            else:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(token[at])
        return last

    def tokens(self, data: bytes) -> list[int]:
        """The encoding of some bytes, read off the last tokens from behind."""
        last, out, end = self.last_tokens(data), [], len(data)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes[token])
        return out[::-1]

    def many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of many pieces of ``data``, none of them empty, end to end, and how many tokens each has."""
        counts = np.zeros(len(starts), np.int64)
        pieces, nths, found = [], [], []
        # the longest first: those with a k-th byte are the first ones
        order = np.argsort(-sizes, kind="stable")
        # a step for all pieces costs about as much as one for each of FEW
        for i in order[:FEW].tolist():
            out = self.tokens(data[starts[i] : starts[i] + sizes[i]].tobytes())[::-1]
            counts[i] = len(out)
            pieces.append(np.full(len(out), i))
            nths.append(np.arange(len(out)))
            found.append(np.array(out, np.int32))
        for a in range(FEW, len(order), BLOCK):
            own = order[a : a + BLOCK]
            first, last = self._lasts(data, starts[own], sizes[own])
            at, end, nth = np.arange(len(own)), sizes[own], 0
            while len(at):
                token = last[first[end - 1] + at]
                pieces.append(own[at])
                nths.append(np.full(len(at), nth))
                found.append(token)
                counts[own[at]] += 1
                end = end - self.sizes[token]
                at, end, nth = at[end > 0], end[end > 0], nth + 1
        ids = np.empty(int(counts.sum()), np.int32)
        upto = np.cumsum(counts)
        for piece, nth, token in zip(pieces, nths, found):
            ids[upto[piece] - 1 - nth] = token
        return ids, counts

    def _lasts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``last_tokens`` of pieces in order of falling size: that of piece i's first k + 1 bytes is at first[k] + i."""
        having = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        first = np.cumsum(having) - having
        last = np.empty(int(having.sum()), np.int32)
        state = np.zeros(len(starts), np.int64)
        for end, n in enumerate(having.tolist()):
            state = self._steps(state[:n], data[starts[:n] + end])
            todo, at = np.arange(n), self.tops[state]
            while len(todo):
                if not at.all():
                    raise ValueError("the vocabulary lacks single bytes")
                token = self.tokens_at[at]
                start = end - self.sizes[token]
                fits = start < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self._fit(last[first[start[inner]] + todo[inner]], token[inner])
                last[first[end] + todo[fits]] = token[fits]
                todo, at = todo[~fits], self.tops[self.falls[at[~fits]]]
        return first, last

    def _steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        after = self.hops.get(state << 8 | byte)
        todo = np.flatnonzero((after < 0) & (state > 0))
        state = state[todo]
        while len(todo):
            state = self.falls[state]
            after[todo] = own = self.hops.get(state << 8 | byte[todo])
            more = (own < 0) & (state > 0)
            todo, state = todo[more], state[more]
        return np.maximum(after, 0).astype(np.int64)

    def _fit(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs; each place of ``pairs`` holds the pair that came there last, and its answer."""
        l = l.astype(np.int64)
        keys = l * self._size + r
        at = (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - (PAIRS - 1).bit_length())).astype(np.int64)
        held = self.pairs[at]
        fits = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != keys)
        if len(new):
            fits[new] = own = self._aparts(l[new], r[new])
            self.pairs[at[new]] = keys[new] << 1 | own
        return fits

    def _aparts(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        out, todo, limit = np.ones(len(l), bool), np.arange(len(l)), np.full(len(l), 1 << 60)
        while len(todo):
            joined = self.merges.get(l * self._size + r)
            met = (joined >= 0) & (joined < limit)
            out[todo[met]] = False
            right, left = self.rights[l], self.lefts[r]
            first = (right >= 0) & ((l > r) | (left < 0))
            more = ~met & (first | (left >= 0))
            limit = np.where(first, l, r + 1)[more]
            l, r, todo = np.where(first, right, l)[more], np.where(first, r, left)[more], todo[more]
        return out

    def _apart(self, l: int, r: int) -> bool:
        """Do the merges leave l and r apart?  Undoes the later of their merges again and again; a merge over
        the seam that ranks before the undone one would have come first."""
        joins, left, right, size, limit = self._joins, self.left, self.right, self._size, 1 << 60
        while True:
            joined = joins.get(l * size + r)
            if joined is not None and joined < limit:
                return False
            if right[l] >= 0 and (l > r or left[r] < 0):
                limit, l = l, right[l]
            elif left[r] >= 0:
                # of equal ranks the one further left merges first, and the seam is left of r
                limit, r = r + 1, left[r]
            else:
                return True

    @cached_property
    def named(self):
        """Arrow: every id in decimal digits and a space."""
        import pyarrow as pa

        return pa.array([f"{i} " for i in range(len(self.bytes))], pa.large_string())

    @cached_property
    def spelt(self):
        """Arrow: every id's bytes."""
        import pyarrow as pa

        return pa.array(self.bytes, pa.large_binary())


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, vocabulary.last_tokens(data)

    def _extend(self, stop: int):
        """Adds the entries up to byte ``stop``, yielding each."""
        v, data, last = self.vocabulary, self.data, self.last
        get, apart, longest = v.ids.get, v.apart, v.longest
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    if not start or apart(last[start - 1], token):
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(token)
            yield end, token

    def append(self, more: bytes) -> None:
        self.data += more
        for _ in self._extend(len(self.data)):
            pass

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replaces bytes; returns how many entries were worked out anew."""
        old, tail = self.last, start + removed
        self.data = self.data[:start] + inserted + self.data[tail:]
        shift, self.last, same = len(inserted) - removed, old[:start], 0
        for end, token in self._extend(len(self.data)):
            before = end - shift
            # entries depend on the bytes and entries of one token's length before them
            same = same + 1 if before > tail and old[before - 1] == token else 0
            if same > self.vocabulary.longest:
                self.last += old[before:]
                return end - start
        return len(self.data) - start

    def ids(self, end: int | None = None) -> list[int]:
        out, end = [], len(self.data) if end is None else end
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class Encoder:
    def __init__(self, raw: bytes, pattern: str):
        import re

        import regex

        self.vocabulary = Vocabulary(raw)
        # \s is spelt out, since libraries differ on it
        inside = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.find = regex.compile(inside).findall
        self.doubtful = re.compile(r"\s (?:\s|\Z)").search

    def pieces(self, chunk: str) -> list[str]:
        return [chunk] if chunk[0] == " " and chunk[1:].isalpha() else self.find(chunk)

    def encode(self, text: str) -> list[int]:
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow string column, end to end, and each text's offsets; nulls count as empty.

        Chunks begin at spaces: a piece never reaches over the space before a chunk, unless white space stands on both
        sides of that space; the chunks of such a text are its pieces.
        """
        import pyarrow as pa

        body, offs = text_bytes(texts)
        begins = body == 0x20
        begins[offs[:-1][offs[:-1] < offs[1:]]] = True
        for row, text in enumerate(texts.to_pylist()):
            if text and self.doubtful(text):
                sizes = [len(p.encode()) for p in self.find(text)]
                begins[offs[row] : offs[row + 1]] = False
                begins[offs[row] + np.cumsum([0, *sizes[:-1]])] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        edges = pa.py_buffer(np.append(starts, len(body)))
        chunk = pa.LargeStringArray.from_buffers(len(starts), edges, pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()
        cuts = list(map(self.pieces, chunk.dictionary.to_pylist()))
        piece = pa.array(chain.from_iterable(cuts), pa.large_string()).dictionary_encode()
        data, at = text_bytes(piece.dictionary)
        # ids of the distinct pieces, of the distinct chunks, of the texts
        ids, counts = self.vocabulary.many(data, at[:-1], np.diff(at))
        ids, edges = _dealt(ids, counts, piece.indices.to_numpy())
        upto = np.zeros(len(cuts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)), out=upto[1:])
        ids, edges = _dealt(ids, np.diff(edges[upto]), chunk.indices.to_numpy())
        return ids, edges[np.searchsorted(starts, offs)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def _dealt(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie end to end, those that ``codes`` names, one after the other, and their edges."""
    first = np.cumsum(sizes) - sizes
    edges = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes[codes], out=edges[1:])
    out = np.empty(edges[-1], values.dtype)
    for a in range(0, len(codes), BLOCK):
        own = codes[a : a + BLOCK]
        b = a + len(own)
        out[edges[a] : edges[b]] = values[np.arange(edges[a], edges[b]) + np.repeat(first[own] - edges[a:b], sizes[own])]
    return out, edges


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw, pattern)
    return _ENCODERS[key]


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, columns) -> DataFrame:
    """mapInArrow over doc_id and text; columns(encoder, ids, offsets) gives the Arrow arrays after doc_id."""
    import pyarrow as pa

    raw = read_ranks(path)
    ship(docs.sparkSession)

    def run(batches):
        own = encoder(raw, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(own, *own.encode_all(part.column("text")))], names=[f.split()[0] for f in schema.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids."""
    import pyarrow as pa

    def columns(own, ids, offs):
        return [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))]

    return _mapped(docs, path, pattern, "doc_id long, ids array<int>", columns)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids; ids that do not spell UTF-8 get replacement characters."""
    import pyarrow as pa

    raw = read_ranks(path)
    ship(tokens.sparkSession)

    def run(batches):
        own = encoder(raw, "")
        for batch in batches:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoding and what decoding it gives, as digests."""
    import pyarrow as pa

    def spelt(values, ids, offs):
        """The values of all ids, end to end, and where each row's begin."""
        taken = values.take(ids)
        _, edges, data = taken.buffers()
        return memoryview(data or b""), np.frombuffer(edges, np.int64, len(ids) + 1)[offs].tolist()

    def columns(own, ids, offs):
        ids = pa.array(ids)
        data, at = spelt(own.vocabulary.named, ids, offs)
        ids_sha = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]
        data, at = spelt(own.vocabulary.spelt, ids, offs)
        text_sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])]
        return [pa.array(np.diff(offs)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return _mapped(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


# -- registered query -----------------------------------------------------------


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
