"""Prompts and JSON: chat markup, budgets of messages, tolerant parsing, paths."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.kernel import jsontext
from pagewright.storage import table

BUDGET, OVERHEAD = 3096, 4


def chat_markup(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, prompt): messages in turn as chat markup. A conversation's messages lie in one row by nature."""
    block = F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.col(text), F.lit("<|im_end|>"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), block.alias("b"))))
    return messages.groupBy(conversation).agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n").alias("prompt"))


def trim_messages(messages: DataFrame, tokens: Column, budget: int = BUDGET, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Messages without the oldest that aren't the system's, so that the rest fits the budget."""
    w = Window.partitionBy(conversation)
    cost = tokens + OVERHEAD
    system = F.coalesce(F.sum(F.when(F.col(role) == "system", cost)).over(w), F.lit(0))
    later = F.sum(F.when(F.col(role) != "system", cost).otherwise(0)).over(w.orderBy(F.desc(turn)))
    return messages.withColumn("_keep", (F.col(role) == "system") | (later + system <= budget)).filter("_keep").drop("_keep")


def merge_text_chunks(chunks: Column) -> Column:
    """Adjacent texts of an array of (kind, text) joined; other kinds stay apart."""
    zero = F.array().cast("array<struct<kind:string,text:string>>")

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(F.lit("text").alias("kind"), F.concat(last["text"], c["text"]).alias("text"))
        same = (F.size(acc) > 0) & (last["kind"] == "text") & (c["kind"] == "text")
        return F.when(same, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(F.array_append(acc, F.struct(c["kind"].alias("kind"), c["text"].alias("text"))))

    return F.aggregate(chunks, zero, step)


def chunks_text(chunks: Column) -> Column:
    """An array of (kind, text) as text; what isn't text by its kind in brackets."""
    return F.array_join(F.transform(chunks, lambda c: F.when(c["kind"] == "text", c["text"]).otherwise(F.concat(F.lit("["), F.initcap(c["kind"]), F.lit("]")))), "")


def tolerant_json(text: Column, path: str = "", **options: bool) -> Column:
    """(value, error): strict JSON text of the document, or of its part at `path`."""

    @F.pandas_udf("value string, error string")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            try:
                found = jsontext.parse_tolerant(t, **options) if t is not None else None
                rows.append((None if t is None else json.dumps(jsontext.focus(found, path) if path else found, ensure_ascii=False), None))
            except (jsontext.JsonError, RecursionError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return run(text)


class JsonEvents:
    """Events of a JSON document in the order in which a reader meets them: (path, kind, value); kinds are object, array, end and value.

    A document that ends early, or has text in front, gives the events up to its end; null gives none.
    """

    def eval(self, text: str):  # noqa: ANN201
        if text is None:
            return
        try:
            found = jsontext.parse_tolerant(text, contaminated=True, abrupt=True)
        except (jsontext.JsonError, RecursionError):
            return
        stack = [("$", found, False)]
        while stack:
            path, node, ended = stack.pop()
            if ended:
                yield path, "end", None
            elif isinstance(node, dict | list):
                yield path, "object" if isinstance(node, dict) else "array", None
                parts = node.items() if isinstance(node, dict) else enumerate(node)
                stack.append((path, None, True))
                stack.extend(reversed([(f"{path}.{k}", v, False) for k, v in parts]))
            else:
                yield path, "value", json.dumps(node, ensure_ascii=False)


def json_events(spark: SparkSession, objects: DataFrame, column: str, *keep: str) -> DataFrame:
    """`keep` columns with (path, kind, value) of every event of the documents in `column`, through the table function `json_events`."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("json_events", udtf(JsonEvents, returnType="path string, kind string, value string"))
    objects.select(*keep, F.col(column).alias("_json")).createOrReplaceTempView("_json_objects")
    return spark.sql(f"select {', '.join([*keep, 'path', 'kind', 'value'])} from _json_objects, lateral json_events(_json)")


def props_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every event's properties."""
    return json_events(spark, table(spark, sf_dir, "events"), "props", "event_id").select("event_id", "path", "kind", F.coalesce("value", F.lit("")).alias("value"))


def path_values(objects: Column, path: str) -> Column:
    """The value at a JSON path, null where it is missing or empty."""
    return F.nullif(F.get_json_object(objects, path), F.lit(""))


def json_path_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", path_values(F.col("props"), "$.k").alias("k")).filter("k is not null")


def chat_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a conversation."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"))
    return chat_markup(e, "user_id", "event_id", "event_type").select("user_id", F.md5("prompt").alias("prompt_md5"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "system").otherwise("user").alias("role"), F.length("props").alias("n"))
    return trim_messages(e, F.col("n"), 100, "user_id", "event_id").select("user_id", "event_id")


QUERIES = {
    "json_events": props_events, "json_path_stream": json_path_stream, "chat_encode": chat_encode, "trim_messages": trimmed,
}
ORACLE = {
    "json_events": """select event_id, '$' as path, unnest(['object', 'end']) as kind, '' as value from events where props is not null union all select event_id, '$.' || unnest(json_keys(props)), 'value', props->>unnest(json_keys(props)) from events where props is not null""",
    "json_path_stream": "select event_id, json_extract_string(props, '$.k') as k from events where nullif(json_extract_string(props, '$.k'), '') is not null",
    "chat_encode": "select user_id, md5(string_agg('<|im_start|>' || event_type || chr(10) || event_type || ' ' || props || '<|im_end|>', chr(10) order by event_id)) as prompt_md5 from events group by user_id",
    "trim_messages": """with e as (select user_id, event_id, case when event_type = 'view' then 'system' else 'user' end as role, length(props) + 4 as cost from events),
w as (select *, coalesce(sum(case when role = 'system' then cost end) over (partition by user_id), 0) as s, sum(case when role <> 'system' then cost else 0 end) over (partition by user_id order by event_id desc rows unbounded preceding) as l from e)
select user_id, event_id from w where role = 'system' or l + s <= 100""",
}
