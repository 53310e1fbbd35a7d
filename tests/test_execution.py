"""Execution records: empty logs, nulls, ties between rules."""

from corvane.plans import execution
from corvane.sources import files

ITEMS = "run int, item int, position int, asset_id int, reason string, current boolean"
ATTEMPTS = "run int, item int, attempt int, state string, outcome string, retryable boolean, received bigint"
PUBLISHED = "run int, item int, published string, quarantined bigint"


def states(spark, items, attempts=(), published=(), budget=10):
    return execution.item_states(spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(attempts), ATTEMPTS), spark.createDataFrame(list(published), PUBLISHED), budget)


def test_item_states_by_first_rule(spark):
    items = [(1, 1, 1, 7, "excluded", None), (1, 2, 2, None, "excluded", True), (1, 3, 3, None, None, True), (1, 4, 4, None, None, False), (1, 5, 5, None, None, None), (2, 1, None, None, None, None), (2, 2, 1, None, None, True)]
    attempts = [(1, 3, 1, "finished", "transient_provider", None, 4), (1, 3, 2, "running", None, False, 8), (9, 9, 1, "running", None, None, None)]
    got = {(r["run"], r["item"]): (r["state"], r["outcome"], r["retryable"], r["received"]) for r in states(spark, items, attempts).collect()}
    assert got == {
        (1, 1): ("satisfied", "already_satisfied", False, 0),
        (1, 2): ("failed", "excluded", False, 0),
        (1, 3): ("interrupted", "interrupted", True, 12),
        (1, 4): ("deferred", "budget_exhausted", True, 0),
        (1, 5): ("deferred", "budget_exhausted", True, 0),
        (2, 1): ("stale", "stale_target", False, 0),
        (2, 2): ("pending", None, False, 0),
    }


def test_results_and_retries(spark):
    items = [(1, 1, 1, 7, None, True), (2, 1, 1, None, "gone", True), (3, 1, 1, None, None, True), (4, 1, 1, None, None, True)]
    attempts = [(3, 1, 1, "running", None, None, 5), (4, 1, 1, "finished", "transient_provider", True, None)]
    s = states(spark, items, attempts)
    assert {r["run"]: (r["status"], r["outcome"]) for r in execution.run_results(s).collect()} == {1: ("complete", "success"), 2: ("failed", "failed"), 3: ("partial", "interrupted"), 4: ("failed", "failed")}
    assert sorted(r["run"] for r in execution.retries(s).collect()) == [3, 4]
    assert sorted(r["run"] for r in execution.retries(s, every=True).collect()) == [2, 3, 4]


def test_empty(spark):
    s = states(spark, [])
    assert s.count() == 0 and execution.run_results(s).count() == 0 and execution.retries(s).count() == 0
    assert execution.request_steps(spark.createDataFrame([], "run int, page int, attempt int, error string"), 5, 3, 5, 1, 9).count() == 0
    probes = execution.probes(spark.createDataFrame([(1, None), (2, "c"), (3, "c")], "plan int, probe string"), spark.createDataFrame([(2, None, None)], "plan int, status int, body string"))
    assert sorted(map(tuple, probes.select("plan", "outcome", "count").collect())) == [(1, "unsupported", None), (2, "malformed_response", None)]


def test_downloads(spark):
    rows = [(1, 0, "a b/", "https://pbs.twimg.com/x", "image/png", None), (2, 123, None, "https://pbs.twimg.com/x", "image/gif", 1), (3, 0, "a", None, "image/png", 1), (4, 0, "a", "https://pbs.twimg.com/x", None, 1)]
    got = files.downloads(spark.createDataFrame(rows, "post_id int, media_index int, author string, url string, content_type string, size bigint"))
    assert sorted((r["post_id"], r["outcome"], r["path"]) for r in got.collect()) == [(1, "downloaded", "a_b/1_00.png"), (2, "downloaded", "unknown/2_123.gif"), (3, "refused_host", None), (4, "not_an_image", None)]
