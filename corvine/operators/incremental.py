"""Processing exactly the new or changed records of each run.

A run rereads from the oldest transaction that was open when the last successful run ended, and an
anti-join of key-and-version pairs with the ledger of what was processed removes the overlap.  The
ledger is written only after its run ended well, so a failed run leaves no trace and its records
come again with the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.session import materialize


def clean_hash(c: Column) -> Column:
    """A content hash without letter case, outer blanks and a leading ``sha256:``; null when nothing is left."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^sha256:\s*", ""))
    return F.when(bare != "", bare)


def usable_fetches(pages: DataFrame) -> DataFrame:
    """url, run_no, at (fetch time), version of the successful fetches that carry a hash."""
    return (
        pages.filter((F.col("http_status") == 200) & F.col("url").isNotNull() & F.col("run_no").isNotNull())
        .select("url", "run_no", F.try_to_timestamp("fetched_at").alias("at"), clean_hash(F.col("content_hash")).alias("version"))
        .filter("version is not null and at is not null")
    )


def ledger_from_documents(documents: DataFrame) -> DataFrame:
    """The ledger before the first run: url, version; urls without a usable hash are absent."""
    return (
        documents.select("url", clean_hash(F.col("content_hash")).alias("version"))
        .filter("url is not null and version is not null")
        .groupBy("url")
        .agg(F.max("version").alias("version"))
        .withColumn("at", F.lit(None).cast("timestamp"))
    )


def reread_start(runs: list[tuple], run_no: int) -> int:
    """First run whose records run_no must read again.

    runs: (run_no, started_at, finished_at, status).  It is the oldest run that was open when the last
    successful run before run_no ended, or the one after that success if none was.  A run of any status
    was open then if it had started and not finished; what it wrote later is not in the ledger.  A run
    without times counts as open unless it succeeded before.
    """
    before = [r for r in sorted(runs) if r[0] < run_no and r[3] == "succeeded"]
    if not before:
        return -(2**31)
    last = before[-1]
    end = last[2]
    still_open = [
        r[0] for r in runs
        if r[0] < last[0] and (end is None or r[1] is None or r[1] <= end) and (r[2] is None or (end is not None and r[2] > end))
    ]
    return min([last[0] + 1, *still_open])


def process_run(pages: DataFrame, ledger: DataFrame, runs: list[tuple], run_no: int) -> tuple[DataFrame, DataFrame]:
    """(records to process, new ledger) of one run.

    ledger: url, version, at.  Records of runs reread_start..run_no are reduced to the latest per url;
    those older than what the ledger holds, and those whose (url, version) the ledger holds, fall away.
    Ties in fetch time go to the greater version.  Neither input may be empty-typed; empty tables give
    empty results.
    """
    return _process(usable_fetches(pages), ledger, runs, run_no)


def _process(fetches: DataFrame, ledger: DataFrame, runs: list[tuple], run_no: int) -> tuple[DataFrame, DataFrame]:
    seen = fetches.filter(F.col("run_no").between(reread_start(runs, run_no), run_no))
    latest = seen.groupBy("url").agg(F.max(F.struct("at", "version")).alias("x")).select("url", "x.version", "x.at")
    fresh = (
        latest.join(ledger.select("url", F.col("at").alias("__at"), F.col("version").alias("__version")), "url", "left")
        .filter(F.col("__at").isNull() | (F.struct("at", "version") > F.struct(F.col("__at").alias("at"), F.col("__version").alias("version"))))
        .select("url", "version", "at")
    )
    todo = fresh.join(ledger.select("url", "version"), ["url", "version"], "left_anti")
    kept = ledger.join(fresh.select("url"), "url", "left_anti")
    return todo.select("url", "version", "at"), kept.unionByName(fresh)


def process_all(pages: DataFrame, documents: DataFrame, runs: DataFrame, max_runs: int = 5_000) -> DataFrame:
    """run_no, url, version of every record that each successful run has to process, by process_run in turn.

    Each run's records and the ledger after it are written before the next run reads them, so a run that
    is lost starts again from the last ledger.  The fetches are reduced to the latest per (url, run) once.
    The list of runs is a driver-side value and is refused beyond max_runs; no successful run gives an
    empty result.
    """
    listed = [tuple(r) for r in runs.select("run_no", "started_at", "finished_at", "status").limit(max_runs + 1).collect()]
    if len(listed) > max_runs:
        raise ValueError(f"more than {max_runs} runs")
    latest = usable_fetches(pages).groupBy("url", "run_no").agg(F.max(F.struct("at", "version")).alias("x"))
    fetches = materialize(latest.select("url", "run_no", "x.at", "x.version"), "fetches")
    ledger = materialize(ledger_from_documents(documents), "ledger")
    out = fetches.limit(0).select("run_no", "url", "version")
    for run_no in sorted(r[0] for r in listed if r[3] == "succeeded" and r[0] is not None):
        todo, after = _process(fetches, ledger, listed, run_no)
        todo = materialize(todo.withColumn("run_no", F.lit(run_no)), "todo")
        ledger = materialize(after, "ledger")
        out = out.unionByName(todo.select("run_no", "url", "version"))
    return out


def replay_runs(pages: DataFrame, documents: DataFrame, runs: DataFrame, max_runs: int = 5_000) -> DataFrame:
    """run_no, url, version of every record that each successful run has to process.

    The same result as process_all, in one shuffle by url:
    the fetches of each run's reread span are reduced per (url, run) before the shuffle, the running
    maximum by fetch time is the ledger as of each run, and the anti-join against the ledger's
    (url, version) pair is the comparison with the row before.  A hot url has at most one row per run
    after the pre-aggregation.  The list of runs is a driver-side value and is refused beyond max_runs.
    Null urls, hashes and run numbers never count; no successful run gives an empty result.
    """
    listed = [tuple(r) for r in runs.select("run_no", "started_at", "finished_at", "status").limit(max_runs + 1).collect()]
    if len(listed) > max_runs:
        raise ValueError(f"more than {max_runs} runs")
    good = sorted(r[0] for r in listed if r[3] == "succeeded" and r[0] is not None)
    spans = F.array(*[F.struct(F.lit(reread_start(listed, r)).alias("lo"), F.lit(r).alias("run")) for r in good])
    if not good:
        spans = F.array().cast("array<struct<lo:int,run:int>>")
    reread_by = F.filter(spans, lambda x: F.col("run_no").between(x["lo"], x["run"]))
    per_run = (
        usable_fetches(pages)
        .select("url", "at", "version", F.explode(F.transform(reread_by, lambda x: x["run"])).alias("run"))
        .groupBy("url", "run")
        .agg(F.max(F.struct("at", "version")).alias("top"))
    )
    start = ledger_from_documents(documents).select(
        "url", F.lit(None).cast("int").alias("run"), F.struct(F.col("at"), F.col("version")).alias("top")
    )
    by_url = W.partitionBy("url").orderBy(F.col("run").asc_nulls_first())
    upto = by_url.rowsBetween(W.unboundedPreceding, W.currentRow)
    fetched = F.when(F.col("run").isNotNull(), F.col("top"))
    held = per_run.unionByName(start).withColumn("__seen", F.max(fetched).over(upto))
    held = held.withColumn("__version", F.coalesce(F.col("__seen.version"), F.col("top.version")))
    before = F.lag("__version").over(by_url)
    return (
        held.withColumn("__before", before)
        .filter(F.col("run").isNotNull() & ~F.col("__version").eqNullSafe(F.col("__before")))
        .select(F.col("run").alias("run_no"), "url", F.col("__version").alias("version"))
    )
