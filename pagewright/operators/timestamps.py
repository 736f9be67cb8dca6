"""Problem 6: one unambiguous UTC instant for each written time.

A value contributes likelihood under each of its valid readings: a format, with the order of day, month and year where the
format leaves it open, or the unit of a bare number. A mixture over these notations is fitted per source by expectation-maximisation; an order
that a source declares weighs as much as all of its values, so that data against it leave the values open. A value is resolved if one reading has nearly all of the posterior and,
where its order was open, that order has support among the source's values of the format; every other value is marked with the reason why
it names no single instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.kernel.timeparse import local_to_utc, readings
from pagewright.storage import bounded_broadcast, staged, table

ORDERS = ("DMY", "MDY", "YMD")
#: Sightings that a declared order adds to each notation of its order, for each of the source's values; those every notation begins with.
DECLARED, LEAST = 1.0, 1e-3
#: Posterior that a reading needs, and share that its order needs among the source's values of its format.
SURE, SUPPORT = 0.99, 0.01
#: Rounds of the mixture at most, and change of the shares at which it ends.
ROUNDS, SETTLED = 1000, 1e-12

_READ = "f_readings array<struct<notation:string,ms:long,off:int>>"
_OWN = ["f_readings", "f_source", "f_shares", "utc_ms", "status"]


def read_times(values: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Adds f_readings, every valid reading of the column `value`; it is empty where there is none."""
    kind = pa.list_(pa.struct([("notation", pa.string()), ("ms", pa.int64()), ("off", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"notation": n, "ms": ms, "off": off} for n, ms, off in readings(v, offsets)] for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "f_readings"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields)
    return values.mapInArrow(run, f"{fields}, {_READ}")


def fit_notations(seen: dict[tuple[str, ...], int], declared: str | None, rounds: int = ROUNDS) -> dict[str, float]:
    """Shares of the notations in one source, by expectation-maximisation over (valid notations of a value, number of such values)."""
    weight = DECLARED * sum(seen.values())
    prior = {n: LEAST + (weight if declared and n.endswith(f"/{declared}") else 0.0) for valid in seen for n in valid}
    share = {n: 1 / len(prior) for n in prior}
    for _ in range(rounds):
        sightings = dict(prior)
        for valid, count in seen.items():
            total = sum(share[n] for n in valid)
            for n in valid:
                sightings[n] += count * share[n] / total
        whole, before = sum(sightings.values()), share
        share = {n: max(x / whole, 1e-15) for n, x in sightings.items()}
        if max((abs(share[n] - before[n]) for n in share), default=0.0) < SETTLED:
            break
    return share


def notation_shares(read: DataFrame) -> DataFrame:
    """(source, shares map<notation, share>) of every source.

    The values are first counted by source and valid notations, a few sets for each source, so that a group stays small whatever the
    source's size.
    """
    valid = F.array_join(F.array_sort(F.transform("f_readings", lambda r: r["notation"])), "|")
    counts = read.filter(F.size("f_readings") > 0).groupBy("source", "declared_order", valid.alias("valid")).agg(F.count(F.lit(1)).alias("n"))

    def run(g: pa.Table) -> pa.Table:
        declared = next((x for x in g.column("declared_order").to_pylist() if x is not None), None)
        seen: dict[tuple[str, ...], int] = {}
        for valid, n in zip(g.column("valid").to_pylist(), g.column("n").to_pylist(), strict=True):
            seen[key] = seen.get(key := tuple(valid.split("|")), 0) + n
        return pa.table({"source": g.column("source")[:1], "shares": pa.array([list(fit_notations(seen, declared).items())], pa.map_(pa.string(), pa.float64()))})

    return counts.groupBy("source").applyInArrow(run, "source string, shares map<string,double>")


def chosen(found: list[dict], shares: dict[str, float]) -> dict | None:
    """The reading that has nearly all of the posterior, None if none has, or if its order has no support in its format."""
    total = sum(shares.get(r["notation"], 0.0) for r in found)
    for r in found:
        share, (family, _, order) = shares.get(r["notation"], 0.0), r["notation"].partition("/")
        if share >= SURE * total and (order not in ORDERS or share >= SUPPORT * sum(x for n, x in shares.items() if n.partition("/")[0] == family)):
            return r
    return None


def instant(found: list[dict], shares: dict[str, float], zone: str | None, fetched: int | None) -> tuple[int | None, str]:
    """(utc_ms, status) of a value with the given readings."""
    if not found:
        return None, "none"
    if (best := chosen(found, shares)) is None:
        return None, "ambiguous order"
    if best["notation"] == "relative":
        return (None, "no fetch time") if fetched is None else (fetched + best["ms"], "resolved")
    if best["off"] is not None:
        return best["ms"], "resolved"
    utc = local_to_utc(best["ms"], zone)
    return utc, "ambiguous local time" if utc is None else "resolved"


def normalise_times(values: DataFrame, zone_offsets: dict[str, int]) -> DataFrame:
    """utc_ms and status for each row of `values`.

    values has value (string), source (string), zone (IANA name of values without offset), declared_order (or null) and
    fetched_ms (for relative times); other columns are carried along. status is `resolved`, or, with a null utc_ms:
    `none` (null, empty, no time, an impossible date or clock), `ambiguous order`, `ambiguous local time` (it occurs
    never or twice in the zone, or the zone isn't known) or `no fetch time`.
    """
    values = values.drop(*({*_OWN} & set(values.columns)))
    read = staged(read_times(values, zone_offsets), "times")  # parsed once, used for the fit and for the choice
    shares = bounded_broadcast(staged(notation_shares(read).select(F.col("source").alias("f_source"), F.col("shares").alias("f_shares")), "notations"))
    joined = read.join(shares, F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source")
    kept = [c for c in read.columns if c != "f_readings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_source: dict[str | None, dict[str, float]] = {}
            out = []
            for i, (found, source, zone, fetched) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("f_readings", "source", "zone", "fetched_ms")), strict=True)):
                if source not in by_source:
                    by_source[source] = dict(batch.column("f_shares")[i].as_py() or ())
                out.append(instant(found, by_source[source], zone, fetched))
            columns = [pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "utc_ms", "status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields)
    return joined.mapInArrow(run, f"{fields}, utc_ms long, status string")


def corpus_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three time columns of the corpus as one table of values with their sources."""
    sites = F.broadcast(table(spark, sf_dir, "sites").select("host", "time_zone", "date_order"))  # fixed at 48 rows
    null = F.lit(None)

    def local(df: DataFrame, field: str, record: str, value: str, url: str, fetched) -> DataFrame:  # noqa: ANN001
        df = df.select(F.lit(field).alias("field_name"), F.col(record).alias("record_id"), F.col(value).alias("value"), site_of(F.col(url)).alias("source"), fetched.alias("fetched_ms"))
        return df.join(sites, F.col("source") == F.col("host"), "left").select("field_name", "record_id", "value", "source", F.col("time_zone").alias("zone"), F.col("date_order").alias("declared_order"), "fetched_ms")

    pages = local(table(spark, sf_dir, "formatted_pages"), "formatted_pages.published_time", "page_id", "published_time", "url", null.cast("long"))
    serp = local(table(spark, sf_dir, "serp_entries"), "serp_entries.date", "entry_id", "date", "link", F.unix_millis(F.col("fetched_at").cast("timestamp")))
    shots = table(spark, sf_dir, "snapshots").select(
        F.lit("snapshots.last_modified").alias("field_name"), F.col("page_id").alias("record_id"), F.col("last_modified").alias("value"),
        F.lit("last-modified").alias("source"), F.lit("UTC").alias("zone"), null.cast("string").alias("declared_order"), null.cast("long").alias("fetched_ms"),
    )
    return pages.unionByName(shots).unionByName(serp).filter(F.length("value") > 0)


def zone_offsets(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The fixed table of zone abbreviations (16 rows)."""
    return {r["abbr"]: r["offset_minutes"] for r in table(spark, sf_dir, "zone_abbrevs").collect()}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, utc_ms) of every value that names exactly one instant."""
    times = normalise_times(corpus_times(spark, sf_dir), zone_offsets(spark, sf_dir))
    return times.filter("status = 'resolved'").select("field_name", "record_id", "utc_ms").distinct()


def p6_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by field and status: how many are resolved and why the others aren't."""
    times = normalise_times(corpus_times(spark, sf_dir), zone_offsets(spark, sf_dir))
    return times.groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("n_values"))


QUERIES = {"p6_found": p6_found, "p6_status": p6_status}
