"""Streams of observations: idle gaps as sessions, throttled reports, early acceptance, last values, event streams put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.kernel.jsontext import EventStream
from pagewright.storage import provide_package, table

#: Quiet times in milliseconds, gap and change of a report.
MUTATION_IDLE, RESOURCE_IDLE, REPORT_GAP, REPORT_CHANGE = 200, 500, 1200, 0.05
#: Time without rows after which a key's state is dropped, in milliseconds.
STATE_MS = 3_600_000


def idle_sessions(events: DataFrame, gap: str = f"{MUTATION_IDLE} milliseconds", key: str = "key", at: str = "at", watermark: str | None = None) -> DataFrame:
    """(key, started, ended, n): bursts of events between idle gaps. Works on streams, given a watermark, and on tables."""
    if watermark:
        events = events.withWatermark(at, watermark)
    return events.groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def latest_observation(observations: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """The last observation of each key, by a struct maximum that is added up before the shuffle."""
    rest = [c for c in observations.columns if c not in (key, order)]
    return observations.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m")).select(key, "m.*")


def presumed_timing(explicit: Column, timeout: Column, iframe: Column, respond_with: Column, elapsed_ms: Column) -> Column:
    """The timing that options imply; elapsed_ms counts from the first look at a snapshot."""
    true = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(explicit.isNotNull(), explicit).when(true(timeout >= 20) | true(iframe), "network-idle").when(true(respond_with.rlike("shot|vlm")), "media-idle")
        .when(true(elapsed_ms > 5000), "mutation-idle").otherwise("resource-idle")
    )


def early_accept(timing: Column, now: Column, seen: dict[str, Column], respond_with: Column, wait_selector: Column, scripts: Column, iframe: Column) -> Column:
    """Whether a snapshot does for a timing.

    now in ms; seen: media_loaded, content_loaded, mutation_idle (times in ms or null), parsed_content, html (strings), pageshot, screenshot,
    is_intermediate (booleans). wait_selector, scripts, iframe: whether the options have them.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    quiet = seen["mutation_idle"].isNotNull()
    media = (timing == "media-idle") & seen["media_loaded"].isNotNull() & quiet & (F.greatest(seen["media_loaded"], F.coalesce(seen["content_loaded"], F.lit(0))) + RESOURCE_IDLE < now)
    resource = (timing == "resource-idle") & seen["content_loaded"].isNotNull() & quiet & (seen["content_loaded"] + RESOURCE_IDLE < now)
    wants = lambda word: true(respond_with.contains("vlm") | respond_with.contains(word))
    return (
        F.when(true(wait_selector), False).when(true(media), True).when(wants("pageshot") & ~true(seen["pageshot"]), False).when(wants("screenshot") & ~true(seen["screenshot"]), False)
        .when(true(resource), True).when(true(scripts), False).when((timing == "visible-content") & some(seen["parsed_content"]), True).when((timing == "html") & some(seen["html"]), True)
        .when(timing == "network-idle", False).when((timing == "mutation-idle") & quiet, True).when(true(respond_with.contains("lm")), False).when(true(iframe), False).otherwise(~true(seen["is_intermediate"]))
    )


Step = Callable[[str, tuple | None, list[tuple], bool], tuple[tuple | None, list[tuple]]]


def stateful(rows: DataFrame, key: str, order: str, step: Step, out: str, state: str, expire_ms: int | None = STATE_MS) -> DataFrame:
    """Rows of each key in order through `step(key, state, rows, last)`, which gives the new state and rows of the schema `out`.

    On a stream the state (schema `state`) is kept between batches and is dropped after `expire_ms` without rows, with a last call without
    rows; rows are in order within a batch. A stream that is to end with its input (trigger availableNow) takes None, since one that waits for
    states to expire runs on. On a table partitions are sorted by key and order and read through, so that no key's rows are
    held together.
    """
    provide_package(rows.sparkSession)
    columns = [c for c in rows.columns if c != key]
    names = [x.split()[0] for x in out.split(", ")]
    place = columns.index(order)

    def told(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names, dtype=object)

    def streamed(own: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        before = tuple(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield told(step(own[0], before, [], True)[1])
            return
        some = sorted((r for b in batches for r in b[columns].itertuples(index=False, name=None)), key=lambda r: r[place])
        after, found = step(own[0], before, some, False)
        if after is not None:
            held.update(after)
            if expire_ms is not None:
                held.setTimeoutDuration(expire_ms)
        yield told(found)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept = None, None
        for batch in batches:
            found: list[tuple] = []
            for now, part in batch.groupby(key, sort=False):
                if own is not None and now != own:
                    found += step(own, kept, [], True)[1]
                    kept = None
                own = now
                kept, more = step(own, kept, list(part[columns].itertuples(index=False, name=None)), False)
                found += more
            yield told(found)
        if own is not None:
            yield told(step(own, kept, [], True)[1])

    if rows.isStreaming:
        return rows.groupBy(key).applyInPandasWithState(streamed, out, state, "append", "NoTimeout" if expire_ms is None else "ProcessingTimeTimeout")
    return rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order).mapInPandas(read, out)


def throttled_reports(observations: DataFrame, expire_ms: int | None = STATE_MS) -> DataFrame:
    """Observations (key, at_ms, elements) worth a report: 1.2 s after the last one, or 5 % more or fewer elements."""

    def step(key: str, last: tuple | None, rows: list[tuple], final: bool) -> tuple[tuple | None, list[tuple]]:
        found = []
        for at, n in rows:
            if last is None or at - last[0] >= REPORT_GAP or abs(n - last[1]) >= REPORT_CHANGE * max(1, last[1]):
                last = (int(at), int(n))
                found.append((key, *last))
        return last, found

    return stateful(observations.select("key", "at_ms", "elements"), "key", "at_ms", step, "key string, at_ms long, elements long", "at_ms long, elements long", expire_ms)


def event_blocks(chunks: DataFrame, expire_ms: int | None = STATE_MS) -> DataFrame:
    """(stream_id, event, data, id, retry) of chunks (stream_id, seq, chunk) of event streams; what is unfinished is kept as state."""

    def step(key: str, before: tuple | None, rows: list[tuple], final: bool) -> tuple[tuple | None, list[tuple]]:
        stream = EventStream()
        stream.rest = before[0] if before else ""
        found = [(key, e.get("event"), e.get("data"), e.get("id"), e.get("retry")) for _, c in rows for e in stream.feed(c or "")]
        return (stream.rest,), found

    return stateful(chunks.select("stream_id", "seq", "chunk"), "stream_id", "seq", step, "stream_id string, event string, data string, id string, retry int", "rest string", expire_ms)


def incremental_text(chunks: DataFrame, expire_ms: int | None = STATE_MS) -> DataFrame:
    """(stream_id, seq, text): after each chunk (stream_id, seq, chunk) the text so far."""

    def step(key: str, before: tuple | None, rows: list[tuple], final: bool) -> tuple[tuple | None, list[tuple]]:
        text, found = before[0] if before else "", []
        for seq, chunk in rows:
            text += chunk or ""
            found.append((key, int(seq), text))
        return (text,), found

    return stateful(chunks.select("stream_id", "seq", "chunk"), "stream_id", "seq", step, "stream_id string, seq long, text string", "text string", expire_ms)


def conflated_writes(values: DataFrame, busy_ms: int, expire_ms: int | None = STATE_MS) -> DataFrame:
    """(key, at_ms, value) of the writes of a writer that takes `busy_ms` for each: what comes while it is busy is put off, and only the newest is
    written when it is free again.

    values: key, at_ms, value. A value put off is written when a later one comes, or when there are no more.
    """

    def step(key: str, before: tuple | None, rows: list[tuple], final: bool) -> tuple[tuple | None, list[tuple]]:
        free, waiting = before or (None, None)
        found = []
        for at, value in rows:
            if waiting is not None and at >= free:
                found.append((key, int(free), waiting))
                free, waiting = free + busy_ms, None
            if free is None or at >= free:
                found.append((key, int(at), value))
                free = int(at) + busy_ms
            else:
                waiting = value
        if final and waiting is not None:
            found.append((key, int(free), waiting))
        return (free, waiting), found

    return stateful(values.select("key", "at_ms", "value"), "key", "at_ms", step, "key string, at_ms long, value string", "free long, waiting string", expire_ms)


def significantly_modified(observations: DataFrame, key: str = "key", order: str = "at", count: str = "elements", threshold: float = 0.05) -> DataFrame:
    """Whether the number of elements changed by more than a share from the first observation to the last."""
    by = observations.groupBy(key).agg(F.min_by(count, order).alias("first"), F.max_by(count, order).alias("last"))
    return by.select(key, (F.abs(F.col("last") - F.col("first")) / F.greatest(F.col("first"), F.lit(1)) > threshold).alias("modified"))


def session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    out = idle_sessions(e, "6 hours")
    return out.select("key", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user's type."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.struct("ts", "event_id").alias("at"), "value")
    return latest_observation(e).select("key", F.col("at.event_id").alias("event_id"))


def modified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose pages' number of elements, from the first seen to the last, changed by more than a twentieth, by day."""
    s = table(spark, sf_dir, "snapshots").filter("elem_count is not null")
    rows = s.select(F.concat_ws(" ", site_of(F.col("url")), F.date_format("observed_at", "yyyy-MM-dd")).alias("key"), F.struct("observed_at", "page_id").alias("at"), F.col("elem_count").cast("long").alias("elements"))
    return significantly_modified(rows)


def text_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a text that grows with each of them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.concat(F.substring("event_type", 1, 1), F.lit(" ")).alias("chunk"))
    return incremental_text(e).select("stream_id", "seq", F.md5("text").alias("text_md5"))


def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's event types through a writer that takes two days for each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("value"))
    return conflated_writes(e, 2 * 86_400_000)


QUERIES = {"incremental_text": text_so_far, "conflated_writes": written_values, "session_idle": session_idle, "latest_snapshot": latest_snapshot, "modified_by_js": modified_pages}
ORACLE = {
    "incremental_text": "select cast(user_id as varchar) as stream_id, event_id as seq, md5(string_agg(event_type[1:1] || ' ', '') over (partition by user_id order by event_id rows unbounded preceding)) as text_md5 from events",
    # from each write to the next: the first value at or after the end of it, or, at its end, the newest that came meanwhile
    "conflated_writes": """with recursive e as (select cast(user_id as varchar) as key, epoch_us(ts) // 1000 as at_ms, event_type as value from events),
w as (select key, min(at_ms) as at_ms, arg_min(value, struct_pack(a := at_ms, b := value)) as value, min(at_ms) as seen from e group by key
union all select key, n.at_ms, n.value, n.seen from (select w.key, w.at_ms + 172800000 as free, w.at_ms as began from w) p join lateral (
  select case when m.newest is not null then p.free else f.first end as at_ms, case when m.newest is not null then m.newest else f.value end as value, p.free as seen
  from (select arg_max(value, struct_pack(a := at_ms, b := value)) as newest from e where e.key = p.key and e.at_ms > p.began and e.at_ms < p.free) m,
    (select min(at_ms) as first, arg_min(value, struct_pack(a := at_ms, b := value)) as value from e where e.key = p.key and e.at_ms >= p.free) f) n on n.at_ms is not null)
select key, at_ms, value from w""",
    "session_idle": """with e as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events),
s as (select key, ts, sum(fresh) over (partition by key order by ts rows unbounded preceding) as g from e)
select key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by key, g""",
    "latest_snapshot": "select user_id || ':' || event_type as key, max_by(event_id, struct_pack(a := ts, b := event_id)) as event_id from events group by 1",
    "modified_by_js": r"""with s as (select regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') || ' ' || strftime(observed_at, '%Y-%m-%d') as key, struct_pack(a := observed_at, b := page_id) as seen, elem_count from snapshots where elem_count is not null),
f as (select key, min_by(elem_count, seen) as a, max_by(elem_count, seen) as b from s group by key)
select key, abs(b - a) / greatest(a, 1) > 0.05 as modified from f""",
}
