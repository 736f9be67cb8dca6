"""Problem 9: mixing sources to target shares of the total size, by Poisson replication.

Each document is used as often as a Poisson variable says, cut off at its source's greatest number of repeats. The variable is the
inverse of the Poisson distribution at a uniform number that is hashed from the document's id and a seed, so that a rerun, or a
task that is run again after a loss, gives the same mixture. The mean of each source is first the one whose expected size is
the target, and is then adjusted to the uniform numbers drawn, so that the shares reached differ from the targets by little more
than a document. Copies are exploded and ordered by a hash, which shuffles the mixture globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.packing import sized_documents
from pagewright.storage import bounded_broadcast, staged, table

#: Share that the scarcest source's room (size times repeats) is used to; a total is derived from it if none is given.
USE_OF_SCARCEST = 0.95
#: Means that are tried for each source in one pass over the sizes, and passes.
GRID, PASSES = 24, 3
SEED = 20_11


def poisson_cdf(mean: float, repeats: int) -> list[float]:
    """P(N <= k) for k below `repeats`."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(repeats):
        total += term
        out.append(min(1.0, total))
        term *= mean / (k + 1)
    return out


def expected_uses(mean: float, repeats: int) -> float:
    """Mean of the Poisson variable cut off at `repeats`."""
    return sum(1 - p for p in poisson_cdf(mean, repeats))


def mean_for(uses: float, repeats: int) -> float:
    """The Poisson mean whose expected uses, cut off at `repeats`, are `uses`."""
    low, high = 0.0, 1.0
    while expected_uses(high, repeats) < uses and high < 700:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if expected_uses(middle, repeats) < uses else (low, middle)
    return high


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) hashed from `key`."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _uses(u: Column, cdf: Column) -> Column:
    """Inverse of the cut-off distribution function at u."""
    return F.size(F.filter(cdf, lambda p: u > p))


def mixing_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """For each source with a target: mean, cdf, target tokens. sizes: (source, u, n_tokens); targets has a row a source."""
    spark = sizes.sparkSession
    rows = targets.filter("target_share > 0 and max_repeats > 0").collect()  # the request itself: a row for each source named in it
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}
    named = bounded_broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    have = {r["source"]: float(r["n"]) for r in sizes.join(named, "source").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if r["n"]}
    wanted = {s: x for s, x in wanted.items() if s in have}
    if not wanted:
        return []
    whole = sum(share for share, _ in wanted.values())
    most = min(have[s] * repeats / (share / whole) for s, (share, repeats) in wanted.items())
    total = min(total or math.inf, USE_OF_SCARCEST * most)
    goal = {s: total * share / whole for s, (share, _) in wanted.items()}
    bounds = {s: (0.0, 2 * mean_for(goal[s] / have[s], r) + 1e-9) for s, (_, r) in wanted.items()}
    best = {s: mean_for(goal[s] / have[s], r) for s, (_, r) in wanted.items()}
    for _ in range(PASSES):
        tried = [(s, k, low + (high - low) * k / (GRID - 1)) for s, (low, high) in bounds.items() for k in range(GRID)]
        grid = spark.createDataFrame([(s, [(k, poisson_cdf(m, wanted[s][1])) for t, k, m in tried if t == s]) for s in wanted], "source string, grid array<struct<k:int,cdf:array<double>>>")
        each = sizes.join(bounded_broadcast(grid, 5_000), "source")  # GRID lists of `max_repeats` numbers a row
        # one row for each source and partition leaves the scan: sums over the grid are kept as columns
        sums = [F.sum(F.col("n_tokens") * _uses(F.col("u"), F.col("grid")[k]["cdf"])).alias(f"n{k}") for k in range(GRID)]
        got = {r["source"]: [float(r[f"n{k}"]) for k in range(GRID)] for r in each.groupBy("source").agg(*sums).collect()}
        for s in wanted:
            means = [m for t, _, m in tried if t == s]
            at = min(range(GRID), key=lambda k: (abs(got[s][k] - goal[s]), k))  # noqa: B023
            best[s] = means[at]
            bounds[s] = (means[max(0, at - 1)], means[min(GRID - 1, at + 1)])
    return [{"source": s, "target_share": wanted[s][0] / whole, "max_repeats": wanted[s][1], "mean": best[s], "cdf": poisson_cdf(best[s], wanted[s][1]), "goal": goal[s]} for s in sorted(wanted)]


def mix(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", total: float | None = None) -> DataFrame:
    """(id, copy, source, n_tokens, place): a row for each use of a document, in a global random order of `place`.

    docs: (id, source, n_tokens). Sources without a target take no part, nor do documents of null or no size. Targets of sources
    without documents are left out and the others scaled up. Repeated ids are drawn alike. The order is that of a hash.
    """
    sizes = staged(docs.select(F.col(id_column).alias("id"), "source", F.col("n_tokens").cast("long").alias("n_tokens"), uniform(F.col(id_column)).alias("u")), "mix").filter("n_tokens > 0")  # filtered once it is written: a filter below would count the tokens twice
    plan = mixing_plan(sizes, targets, total)
    table_ = sizes.sparkSession.createDataFrame([(p["source"], p["cdf"]) for p in plan], "source string, cdf array<double>")
    used = sizes.join(bounded_broadcast(table_), "source").withColumn("n_uses", _uses(F.col("u"), F.col("cdf"))).filter("n_uses > 0")
    copies = used.select("id", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("copy"), "source", "n_tokens")
    placed = copies.withColumn("place", F.xxhash64("id", "copy", F.lit(SEED + 1)))
    return placed.repartitionByRange("place").sortWithinPartitions("place").withColumnRenamed("id", id_column)


def shares(mixture: DataFrame, targets: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Target and actual share, tokens, documents and repeats of each source of the mixture."""
    by = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_uses"), F.count_distinct(id_column).alias("n_docs"), F.max("copy").alias("most_repeats"))
    joined = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")  # a row for each source on both sides
    whole = F.sum("n_tokens").over(Window.partitionBy())
    return joined.select(
        "source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / whole).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: a row for each use of a document."""
    return mix(sized_documents(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: whether its size is within three of the largest documents of its target, whether no document is used too often, and how many aren't the source's."""
    mixture = staged(p9_mixture(spark, sf_dir), "mixture")
    reached = shares(mixture, table(spark, sf_dir, "mix_targets"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    by = mixture.join(docs, "doc_id", "left").groupBy("source").agg(F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"), F.max("n_tokens").alias("largest"))
    whole = Window.partitionBy()  # a row for each source
    joined = reached.join(by, "source", "left").withColumn("whole", F.sum("n_tokens").over(whole)).withColumn("step", F.max("largest").over(whole))
    near = F.abs(F.col("n_tokens") - F.col("target_share") * F.col("whole")) <= 3 * F.col("step")
    return joined.select("source", near.alias("near"), (F.col("most_repeats") <= F.col("max_repeats")).alias("kept"), F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_rules": p9_rules}
# What any mixture must keep: shares near their targets, no more repeats than allowed, documents of the source itself.
ORACLE = {"p9_rules": "select source, true as near, true as kept, cast(0 as bigint) as n_foreign from mix_targets"}
