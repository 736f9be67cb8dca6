"""Problem 8: filling containers of fixed capacity with whole documents, by best-two-fit.

A container is filled greedily, each time with the largest document that still fits. Then its smallest document is swapped for
two unpacked ones that fit the widened gap more tightly. A document larger than the capacity is split into full containers
and a rest that is packed like any other. Documents are packed in shards of bounded size, spread by a hash, so that neither a
large source nor the corpus's size puts more into a task; a shard leaves at most its last containers partly empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.tokenize import count_tokens
from pagewright.storage import staged, table

#: Most documents of a shard, on average.
SHARD = 20_000


class Sizes:
    """A multiset of sizes that finds the largest size at most as large as a bound."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        for s in sizes:
            self.count[s] += 1
        self.present = sorted({s for s in sizes})
        self.n = len(sizes)

    def largest(self, bound: int) -> int | None:
        at = bisect_right(self.present, bound)
        return self.present[at - 1] if at else None

    def take(self, size: int) -> None:
        self.count[size] -= 1
        self.n -= 1
        if not self.count[size]:
            self.present.pop(bisect_right(self.present, size) - 1)

    def give(self, size: int) -> None:
        if not self.count[size]:
            self.present.insert(bisect_right(self.present, size), size)
        self.count[size] += 1
        self.n += 1

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """Two sizes whose sum is the largest that is at most `gap`."""
        best, pair = -1, None
        low, high = 0, bisect_right(self.present, gap - 1) - 1
        while low <= high and high >= 0:
            total = self.present[low] + self.present[high]
            if total > gap:
                high -= 1
                continue
            if total > best and (low != high or self.count[self.present[low]] > 1):
                best, pair = total, (self.present[low], self.present[high])
                if best == gap:
                    break
            low += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is between 1 and the capacity."""
    left, bins = Sizes(sizes, capacity), []
    while left.n:
        content, gap = [], capacity
        while (size := left.largest(gap)) is not None:
            left.take(size)
            content.append(size)
            gap -= size
        if gap and content:  # the last one put in is the smallest
            smallest = content[-1]
            pair = left.best_two(gap + smallest) if left.n > 1 else None
            if pair and sum(pair) > smallest:
                content.pop()
                left.give(smallest)
                for size in pair:
                    left.take(size)
                content += pair
        bins.append(content)
    return bins


def pack(docs: DataFrame, capacities: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", shard: int = SHARD) -> DataFrame:
    """(pack_id, container, id, part, n_tokens): where each document, or each part of a split one, is.

    docs: a row for each document with its size; a null size or one below 1 takes no room and is left out. capacities:
    (pack_id, capacity_tokens). Repeated ids are packed as often as they come. container is unique within a pack_id.
    """
    base = docs.select(F.col(id_column).alias("id"), F.col(size_column).cast("long").alias("size")).filter("size > 0")
    n_shards = max(1, -(-base.count() // shard))
    base = base.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n_shards)).cast("int"))
    asked = capacities.select("pack_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().collect()  # the request itself, a row for each capacity
    kind = f"array<struct<pack_id:{dict(capacities.dtypes)['pack_id']},capacity:bigint>>"
    each = F.array(*[F.struct(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["capacity"]).alias("capacity")) for r in asked if r["capacity"]]).cast(kind)
    wide = base.select("*", F.inline(each))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        capacity, pack_id, number = int(g["capacity"].iloc[0]), g["pack_id"].iloc[0], int(g["shard"].iloc[0])
        g = g.sort_values(["size", "id"])
        rows, pieces, n = [], {}, 0
        for key, size in zip(g["id"].tolist(), g["size"].tolist(), strict=True):
            part = 0
            while size > capacity:
                rows.append((f"{number}-{n}", key, part, capacity))
                size, part, n = size - capacity, part + 1, n + 1
            pieces.setdefault(size, []).append((key, part))
        for content in best_two_fit([s for s, x in pieces.items() for _ in x], capacity):
            for size in content:
                key, part = pieces[size].pop()
                rows.append((f"{number}-{n}", key, part, size))
            n += 1
        out = pd.DataFrame(rows, columns=["container", "id", "part", "n_tokens"])
        out.insert(0, "pack_id", pack_id)
        return out

    kinds = dict(docs.dtypes)
    out = f"pack_id {dict(capacities.dtypes)['pack_id']}, container string, id {kinds[id_column]}, part int, n_tokens long"
    packed = wide.groupBy("pack_id", "shard").applyInPandas(run, out)
    return packed.withColumnRenamed("id", id_column)


def sized_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, n_tokens and `columns`) of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *columns, count_tokens(F.col("text")).alias("n_tokens"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container, or containers if it is split, for each capacity."""
    return pack(staged(sized_documents(spark, sf_dir), "sizes"), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of the room used, by capacity."""
    sizes = table(spark, sf_dir, "pack_sizes")
    by = p8_packed(spark, sf_dir).groupBy("pack_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return by.join(sizes, "pack_id").withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By capacity: documents packed, containers beyond it, documents in two containers without need, and containers at all against the least number there can be."""
    packed = staged(p8_packed(spark, sf_dir), "packed").join(table(spark, sf_dir, "pack_sizes"), "pack_id")
    bins = packed.groupBy("pack_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    docs = packed.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("size"), F.count_distinct("container").alias("parts"))
    over = bins.groupBy("pack_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_over"), (F.sum("used") / F.sum("capacity_tokens") >= 0.97).alias("full"))
    split = docs.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_split"))
    return over.join(split, "pack_id").select("pack_id", "n_documents", "n_over", "n_split", "full")


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p8_rules": p8_rules}

# What any packing must keep: every document with text once, nothing above the capacity, no needless split.
ORACLE = {"p8_rules": "select pack_id, (select count(*) from documents where length(text) > 0) as n_documents, cast(0 as bigint) as n_over, cast(0 as bigint) as n_split, true as \"full\" from pack_sizes"}
