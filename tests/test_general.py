"""Timestamps, incremental runs and the oracle comparison of a few queries."""

import datetime as dt

import pytest

from corvine.operators import incremental as inc
from corvine.operators.timestamps import instants_with_sites, normalize_instants

CASES = [
    ("2024-03-31T02:24:05", "Europe/London", True, "2024-03-31T01:24:05"),  # skipped, moves later
    ("2025-11-02T01:09:09", "America/Los_Angeles", False, "2025-11-02T08:09:09"),  # twice, the earlier
    ("2023-02-28", "Asia/Tokyo", False, "2023-02-27T15:00:00"),
    ("12/07/2023 02:31", "UTC", False, "2023-12-07T02:31:00"),
    ("12/07/2023 02:31", "UTC", True, "2023-07-12T02:31:00"),
    ("12. März 2024, 05:47 Uhr", "Europe/Berlin", True, "2024-03-12T04:47:00"),
    ("Sun, 6 Aug 2023 06:08:17 -0700", "UTC", False, "2023-08-06T13:08:17"),
    ("August 16, 2024 12:50 AM EDT", "America/New_York", False, "2024-08-16T04:50:00"),
    ("2026-02-27T16:15:18.071623723Z", "UTC", False, "2026-02-27T16:15:18.071623"),
    ("2024-12-24 20:03:51,762-05:00", "UTC", False, "2024-12-25T01:03:51.762000"),
    ("20260228T075331Z", "UTC", False, "2026-02-28T07:53:31"),
    ("2024-10-28T06:53:20[America/Los_Angeles]", "UTC", False, "2024-10-28T13:53:20"),
    ("1708053207", "UTC", False, "2024-02-16T03:13:27"),
    ("1775307101073", "UTC", False, "2026-04-04T12:51:41.073000"),
    (" 2024-02-29T17:35:07z ", "UTC", False, "2024-02-29T17:35:07"),
    ("07-May-2025 12:56:52", "Australia/Sydney", True, "2025-05-07T02:56:52"),
    *[(x, "UTC", False, None) for x in ("2026-02-30", "0000-00-00", "2025-13-04T09:00:00Z", "2025-06-11T27:12:00Z", "soon", "", "-", "13/13/2024 10:00 AM", "2024-01-01 10:00:00 Mars/Base", "x" * 100_000)],
    (None, "UTC", False, None),
    ("2024-01-01 10:00", None, None, None),
    ("2024-01-01T10:00:00Z", None, None, "2024-01-01T10:00:00"),
]


def test_instants(spark):
    rows = [(i, *c[:3], "kept") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string, z string, f boolean, instant_us string")
    got = {r["i"]: r["instant_us"] for r in normalize_instants(df, "v", "z", "f").collect()}
    assert len(got) == len(CASES)
    for i, (text, _, _, want) in enumerate(CASES):
        have = None if got[i] is None else dt.datetime.fromtimestamp(got[i] / 1e6, dt.UTC).replace(tzinfo=None)
        assert have == (want and dt.datetime.fromisoformat(want)), text and text[:50]


def test_instants_of_unknown_product_and_empty_table(spark):
    sites = spark.createDataFrame([("p", "UTC", False)], "product string, tz_name string, day_first boolean")
    df = spark.createDataFrame([(1, "2024-01-01", "p"), (2, "2024-01-01", "q"), (3, "2024-01-01", None), (4, "2024-01-01T00:00:00Z", "q")], "id bigint, v string, product string")
    assert {r["rec_id"] for r in instants_with_sites(df, sites, "id", "v", "k").collect()} == {1, 4}
    assert instants_with_sites(df.limit(0), sites, "id", "v", "k").count() == 0


PAGES = [
    # rec, run, url, at, hash, status
    (1, 1, "a", "2024-01-01T00:00:00+00:00", "sha256:AA", 200), (2, 1, "b", "2024-01-01T00:00:00+00:00", "x1", 200), (3, 2, "a", "2024-01-02T00:00:00+00:00", " aa ", 200),
    (4, 3, "a", "2024-01-03T00:00:00+00:00", "bb", 200), (5, 3, "b", "2024-01-03T00:00:00+00:00", "x2", 500), (6, 4, "b", "2023-12-01T00:00:00+00:00", "x0", 200),
    (7, 4, "c", "2024-01-04T00:00:00+00:00", "  ", 200), (8, 4, "c", "2024-01-04T00:00:00+00:00", None, 200), (9, 5, "a", "2024-01-05T00:00:00+00:00", "aa", 200), (9, 5, "a", "2024-01-05T00:00:00+00:00", "aa", 200),
    (10, 6, None, "2024-01-05T00:00:00+00:00", "zz", 200),
]
RUNS = [(1, "succeeded"), (2, "succeeded"), (3, "failed"), (4, "succeeded"), (5, "succeeded"), (6, "running")]


@pytest.fixture
def crawl(spark):
    pages = spark.createDataFrame(PAGES, "rec_id bigint, run_no int, url string, fetched_at string, content_hash string, http_status int")
    docs = spark.createDataFrame([("a", "AA"), ("z", None)], "url string, content_hash string")
    runs = spark.createDataFrame([(r, dt.datetime(2024, 1, r), None if s != "succeeded" else dt.datetime(2024, 1, r, 5), s) for r, s in RUNS], "run_no int, started_at timestamp, finished_at timestamp, status string")
    return pages, docs, runs


def test_replay_equals_the_runs_in_turn(crawl):
    pages, docs, runs = crawl
    got = {(r["run_no"], r["url"], r["version"]) for r in inc.replay_runs(pages, docs, runs).collect()}
    assert got == {(1, "b", "x1"), (4, "a", "bb"), (5, "a", "aa")}
    listed = [tuple(r) for r in runs.collect()]
    ledger, turn = inc.ledger_from_documents(docs), set()
    for run in (1, 2, 4, 5):
        todo, ledger = inc.process_run(pages, ledger, listed, run)
        turn |= {(run, r["url"], r["version"]) for r in todo.collect()}
    assert turn == got


def test_replay_of_empty_tables(crawl):
    pages, docs, runs = crawl
    assert inc.replay_runs(pages.limit(0), docs, runs).count() == 0
    assert inc.replay_runs(pages, docs.limit(0), runs.limit(0)).count() == 0


def test_late_rows_of_open_runs_are_read(spark):
    """What a run that was still open writes after a later success is read by the next run, whatever the open run's status."""
    t = lambda h: dt.datetime(2024, 1, 1, h)
    docs = spark.createDataFrame([], "url string, content_hash string")
    row = lambda url, run, h: (url, run, 200, f"2024-01-01T{h:02}:00:00Z", f"h{h}")
    schema = "url string, run_no int, http_status int, fetched_at string, content_hash string"
    for status, finished in (("running", None), ("failed", t(9)), ("succeeded", t(9))):
        runs = [(1, t(1), finished, status), (2, t(2), t(4), "succeeded"), (3, t(5), t(6), "succeeded")]
        assert inc.reread_start(runs, 3) == 1
        early = spark.createDataFrame([row("a", 2, 3)], schema)
        late = early.unionByName(spark.createDataFrame([row("b", 1, 5), row("c", 3, 5)], schema))
        todo, ledger = inc.process_run(early, inc.ledger_from_documents(docs), runs, 2)
        assert [r["url"] for r in todo.collect()] == ["a"]
        todo, ledger = inc.process_run(late, ledger, runs, 3)
        assert sorted(r["url"] for r in todo.collect()) == ["b", "c"] and ledger.count() == 3
    assert inc.reread_start([(1, t(1), t(2), "failed"), (2, t(3), t(4), "succeeded")], 3) == 3


def test_all_runs_in_turn_equal_one_shuffle(spark, crawl):
    pages, docs, runs = crawl
    rows = lambda df: sorted((r["run_no"], r["url"], r["version"]) for r in df.collect())
    assert rows(inc.process_all(pages, docs, runs)) == rows(inc.replay_runs(pages, docs, runs)) != []
    assert inc.process_all(pages.limit(0), docs, runs).count() == 0
