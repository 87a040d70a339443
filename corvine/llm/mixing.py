"""Mixing sources to target shares of tokens by iterative proportional fitting (problem 9).

Token sums per cell (source, language, topic) are counted over all documents.  The total is the
largest at which every present source reaches its share within its repeat cap.  Cell weights start
at 1 and are raked to the marginals in turn, source last.  A document is used
floor(weight + u) times, u being a uniform value fixed by its id, which makes the expected use equal
to the weight; a last factor per source makes the shares exact but for one document.  The uses of a
document step up at the factors (n - u) / weight; the factor is the quantile of those steps by tokens,
found in a few passes over the rows, each of which refines the deciding bin of every source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.session import bounded_broadcast, materialize

BINS = 4096
MAX_BINS = 1 << 18
"""Bins of one source, and most of all sources together, that come to the driver in one pass."""
MAX_CELLS = 20_000
"""Most cells that are raked on the driver; more are raked by joins."""


@dataclass(frozen=True)
class MixOptions:
    rounds: int = 60
    tolerance: float = 1e-6
    seed: int = 3
    total_tokens: float | None = None
    """Tokens of the mixture; by default the most at which all shares can be reached."""
    max_cells: int = MAX_CELLS


def language(c: Column) -> Column:
    """Language code without region and case; missing ones are 'und'."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, "^([A-Za-z]{2,3})", 1)), F.lit("")), F.lit("und"))


def rake(tokens: np.ndarray, cells: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Weights of the cells so that weighted token sums meet each marginal; the first marginal is met last.

    cells: per marginal the class of each cell; targets: per marginal the token sum of each class.
    Weights stay within caps; a class whose cells are all capped stays below its target.
    """
    w = np.minimum(1.0, caps)
    for _ in range(rounds):
        before = w.copy()
        for of, target in [*zip(cells[1:], targets[1:]), (cells[0], targets[0])]:
            reached = np.bincount(of, w * tokens, minlength=len(target))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(reached > 0, target / reached, 1.0)
            w = np.minimum(w * factor[of], caps)
        if (np.abs(w - before) <= tolerance * w).all():
            break
    return w


def raked(cells: DataFrame, goals: DataFrame, scale: float, options: MixOptions) -> DataFrame:
    """cells with their weights w, raked like in rake, but by sums and joins over any number of cells.

    cells: source, language, topic, t (tokens); goals: source, cap, wanted (tokens).  Languages and
    topics keep their tokens times ``scale``.  Each round is written, so that plans stay short; hot
    classes are only sums, pre-aggregated before the shuffle.
    """
    now = cells.join(goals, "source").withColumn("w", F.least(F.lit(1.0), F.col("cap")))
    for name in ("language", "topic"):
        now = now.join(cells.groupBy(name).agg((F.sum("t") * scale).alias(f"{name}_goal")), name)
    now = materialize(now.withColumnsRenamed({"wanted": "source_goal"}), "cells")
    for _ in range(options.rounds):
        before = now.withColumn("before", F.col("w"))
        for name in ("language", "topic", "source"):
            reached = before.groupBy(name).agg(F.sum(F.col("w") * F.col("t")).alias("reached"))
            factor = F.when(F.col("reached") > 0, F.col(f"{name}_goal") / F.col("reached")).otherwise(1.0)
            before = before.join(bounded_broadcast(reached, 1_000_000), name).withColumn("w", F.least(F.col("w") * factor, F.col("cap"))).drop("reached")
        before = materialize(before, "cells")
        change = before.agg(F.max(F.abs(F.col("w") - F.col("before")) - options.tolerance * F.col("w"))).first()[0]
        now = before.drop("before")
        if change is None or change <= 0:
            break
    return now.select("source", "language", "topic", "t", "w")


def _uses(f: Column) -> Column:
    """How many of a document's steps, (n - u) / w for n from 1 to cap, are at most f."""
    step = lambda n: (n - F.col("u")) / F.col("w")
    near = F.floor(F.col("w") * f + F.col("u"))
    n = near + F.when(step(near + 1) <= f, 1).otherwise(0) - F.when(step(near) > f, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(n, F.col("cap"))).cast("bigint")


def exact_factors(drawn: DataFrame, goals: np.ndarray, guess: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per source the factor at which the tokens drawn come nearest to its goal.

    drawn: k (number of the source), w (weight), u, cap, n_tokens.  guess: factors to begin at; most:
    factors at which every document is used up to its cap.  A pass sums the steps within each source's
    bracket by bins, and the bin that reaches the goal, cut to its outermost steps, is the next bracket.
    """
    spark = drawn.sparkSession
    bins = max(16, min(BINS, MAX_BINS // max(len(goals), 1)))
    lo, hi = np.minimum(guess, most) / 2, np.minimum(guess * 2, most)
    factor, left = np.ones(len(goals)), [k for k in range(len(goals)) if np.isfinite(most[k])]
    while left:
        bracket = spark.createDataFrame([(k, float(lo[k]), float(hi[k])) for k in left], "k int, lo double, hi double")
        t = (F.col("n") - F.col("u")) / F.col("w")
        at = F.floor((t - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
        steps = (
            drawn.join(F.broadcast(bracket), "k")  # one row a source
            .withColumn("low", _uses(F.col("lo")))
            # the first entry stands for all steps up to lo
            .withColumn("n", F.explode(F.sequence("low", F.greatest("low", _uses(F.col("hi"))))))
            .select(
                "k", F.when(F.col("n") == F.col("low"), -1).otherwise(F.greatest(F.lit(0), F.least(at, F.lit(bins - 1)))).alias("bin"), t.alias("t"),
                F.when(F.col("n") == F.col("low"), F.col("low")).otherwise(1).cast("bigint") * F.col("n_tokens").cast("bigint"),
            ).toDF("k", "bin", "t", "tokens")
        )
        sums = steps.groupBy("k", "bin").agg(F.sum("tokens").alias("s"), F.min("t").alias("a"), F.max("t").alias("b")).toPandas()
        by = dict(list(sums.sort_values("bin").groupby("k")))
        for k in list(left):
            own = by[k]
            base, own = float(own.loc[own["bin"] < 0, "s"].sum()), own[own["bin"] >= 0]
            reached = base + own["s"].to_numpy(float).cumsum()
            j = int(np.searchsorted(reached, goals[k]))
            if base >= goals[k] and base > 0:  # the goal lies below the bracket
                lo[k], hi[k] = (lo[k] / 64 if lo[k] > 1e-12 * guess[k] else 0.0), lo[k]
            elif j < len(reached):
                a, b, before = own["a"].iloc[j], own["b"].iloc[j], reached[j - 1] if j else base
                lo[k], hi[k] = np.nextafter(a, 0.0), b
                if a == b:  # one step, or equal ones
                    factor[k] = lo[k] if goals[k] - before < reached[j] - goals[k] else hi[k]
                    left.remove(k)
            elif hi[k] < most[k]:
                lo[k], hi[k] = hi[k], min(hi[k] * 64, most[k])
            else:  # every document up to its cap
                factor[k] = most[k]
                left.remove(k)
    return factor


def mixture(documents: DataFrame, targets: DataFrame, options: MixOptions = MixOptions()) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).  documents: doc_id, source, lang, manual, n_tokens; targets as mix_targets.

    mixture: doc_id, source, n_tokens, n_uses of the documents used.  report: source, target_share,
    reached_share, target_of_present (the share among the sources that have tokens), available_tokens,
    mixed_tokens, n_documents, max_repeats; one row per target.  Documents without source, of a source
    that is no target, or without tokens are not used; a target without documents reaches 0 and its
    share is divided among the others in proportion.  A repeated target row counts by its greatest
    share; null shares and caps below 1 make a source unusable.  A source holding a third of all rows
    is no group anywhere: only sums per cell and bin are grouped, pre-aggregated by the scan.  documents
    are read in several passes, so a costly plan is written to a table first.
    """
    spark = documents.sparkSession
    goal = targets.filter("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    goals = {r[0]: (r[1] or 0.0, r[2] or 0) for r in goal.limit(10_001).collect()}
    if len(goals) > 10_000:
        raise ValueError("more than 10000 target sources")
    wanted = bounded_broadcast(goal.filter("target_share > 0 and max_repeats >= 1").select("source", "max_repeats"), 10_000)
    rows = (
        documents.filter("n_tokens > 0")
        .join(wanted, "source")
        .select(
            "doc_id", "source", language(F.col("lang")).alias("language"), F.coalesce("manual", F.lit("")).alias("topic"),
            "n_tokens", ((F.pmod(F.xxhash64("doc_id", F.lit(options.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u"),
        )
    )
    key = ["source", "language", "topic"]
    cells = materialize(rows.groupBy(*key).agg(F.sum("n_tokens").cast("bigint").alias("t")), "cells")
    have = {r[0]: float(r[1]) for r in cells.groupBy("source").agg(F.sum("t")).collect()}  # one row a source
    names = sorted(have)
    avail = np.array([have[s] for s in names])
    share = np.array([goals[s][0] for s in names])
    cap = np.array([goals[s][1] for s in names], float)
    share = share / share.sum() if len(share) else share
    total = options.total_tokens or (float((avail * cap / share).min()) if len(share) else 0.0)
    goals_of, scale = share * total, total / avail.sum() if len(names) else 0.0
    few = cells.limit(options.max_cells + 1).toPandas()
    if len(few) <= options.max_cells:
        tokens, of_source = few["t"].to_numpy(float), np.searchsorted(names, few["source"]) if names else np.zeros(0, int)
        marginals, goals_by = [of_source], [goals_of]
        for c in ("language", "topic"):
            classes, of = np.unique(few[c].to_numpy(str), return_inverse=True)
            marginals.append(of)
            goals_by.append(np.bincount(of, tokens, minlength=len(classes)) * scale)
        w = rake(tokens, marginals, goals_by, cap[of_source], options.rounds, options.tolerance) if len(tokens) else tokens
        table = spark.createDataFrame([(*r, float(x)) for r, x in zip(few[key].itertuples(index=False), w)], "source string, language string, topic string, w double")
    else:
        wanted_of = [(s, float(c), float(g)) for s, c, g in zip(names, cap, goals_of)]
        table = raked(cells, spark.createDataFrame(wanted_of, "source string, cap double, wanted double"), scale, options).drop("t")
    numbers = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "source string, k int")
    weighted = materialize(table.filter("w > 0").join(F.broadcast(numbers), "source"), "weights")
    lowest = {r[0]: r[1] for r in weighted.groupBy("k").agg(F.min("w")).collect()}
    drawn = rows.join(bounded_broadcast(weighted, options.max_cells), key).join(wanted.withColumnRenamed("max_repeats", "cap"), "source")
    least = np.array([lowest.get(k, np.inf) for k in range(len(names))])
    factor = exact_factors(drawn, goals_of, np.ones(len(names)), cap / least)
    factors = spark.createDataFrame([(k, float(f)) for k, f in enumerate(factor)], "k int, factor double")
    mixed = (
        drawn.join(F.broadcast(factors), "k")  # one row a source
        .withColumn("n_uses", _uses(F.col("factor")).cast("int"))
        .filter("n_uses > 0")
        .select("doc_id", "source", "n_tokens", "n_uses")
    )
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_documents"))
    present = spark.createDataFrame(
        [(s, float(a), float(x)) for s, a, x in zip(names, avail, share)], "source string, available_tokens double, target_of_present double"
    )
    report = goal.join(F.broadcast(present), "source", "left").join(reached, "source", "left").na.fill(0)
    everything = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.join(F.broadcast(everything), F.lit(True), "left").select(
        "source", "target_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), "target_of_present",
        F.col("available_tokens").cast("bigint").alias("available_tokens"), "mixed_tokens", "n_documents", "max_repeats",
    )
    return mixed, report
