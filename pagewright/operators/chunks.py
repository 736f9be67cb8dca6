"""Chunks of markdown at its headings, as array expressions: no shuffle, whole documents in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import table


_NODE = "struct<ord:int,level:int,title:string,mark:string,content:string,body:string,parents:array<string>>"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_headings(markdown: Column) -> Column:
    """Pieces that begin at headings."""
    return F.split(markdown, r"\n(?=#{1,6} )")


def heading_nodes(markdown: Column) -> Column:
    """Array of (ord, level, title, mark, content, body, parents), one for each piece; a piece without a line break behind its heading is none (level 0).

    mark is the heading as written, body the piece without it, parents the headings above, outermost first. One pass along the pieces, which
    carries the open headings: a heading closes those of its level and deeper.
    """
    zero = F.struct(F.array().cast("array<struct<level:int,mark:string>>").alias("open"), F.array().cast(f"array<{_NODE}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        front = F.regexp_replace(piece, r"^\s+", "")
        first = F.rtrim(F.regexp_extract(front, r"^(#[^\n]*)\n", 1))
        is_heading = first != ""
        level = F.length(F.regexp_extract(first, "^(#{1,6})", 1))
        above = F.filter(acc["open"], lambda x: x["level"] < level)
        node = F.struct(
            F.size(acc["out"]).alias("ord"), F.when(is_heading, level).otherwise(0).alias("level"), F.when(is_heading, F.regexp_replace(first, r"^#{1,6}\s*", "")).alias("title"),
            F.when(is_heading, first).alias("mark"), F.when(is_heading, F.regexp_replace(front, r"\s+$", "")).otherwise(piece).alias("content"),
            F.when(is_heading, _trim(F.substr(front, F.length(first) + 1))).otherwise(piece).alias("body"), F.transform(F.when(is_heading, above).otherwise(acc["open"]), lambda x: x["mark"]).alias("parents"),
        )
        opened = F.when(is_heading, F.array_append(above, F.struct(level.alias("level"), first.alias("mark")))).otherwise(acc["open"])
        return F.struct(opened.alias("open"), F.array_append(acc["out"], node.cast(_NODE)).alias("out"))

    return F.aggregate(split_headings(markdown), zero, step, lambda acc: acc["out"])


def chunk(markdown: Column, depth: int = 4, contextual: bool = False, title: Column | None = None) -> Column:
    """Chunks: a heading up to `depth` begins one; deeper ones and plain pieces join the chunk before. Empty ones are dropped.

    The pieces of a chunk are joined by a blank line, those of the last one by a line break. contextual: a chunk begins with the
    page's title, the headings above its own and that one, as written, each once.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))
    lines = lambda parts, glue: _trim(F.array_join(F.filter(parts, lambda x: x != ""), glue))

    def step(acc: Column, n: Column) -> Column:
        plain = n["mark"].isNull() & (n["content"] != "")
        starts = ~plain & (n["level"] <= depth)
        head = F.filter(F.array_distinct(F.concat(F.array(F.concat(F.lit("# "), F.coalesce(title, F.lit("")) if title is not None else F.lit(""))), n["parents"], F.array(F.coalesce(n["mark"], F.lit(""))))), lambda x: x != "")
        fresh = F.concat(F.array_join(head, "\n"), F.lit("\n\n"), _trim(n["body"])) if contextual else _trim(n["content"])
        flushed = F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], lines(acc["now"], "\n\n"))).otherwise(acc["done"])
        return F.struct(F.when(starts, flushed).otherwise(acc["done"]).alias("done"), F.when(starts, F.array(fresh)).otherwise(F.array_append(acc["now"], n["content"])).alias("now"))

    last = lambda acc: F.filter(F.array_append(acc["done"], lines(acc["now"], "\n")), lambda c: c != "")
    return F.aggregate(heading_nodes(markdown), zero, step, last)


def joined_chunks(chunks: Column) -> Column:
    """Chunks as one text, with a separator that markdown doesn't hold."""
    return F.array_join(chunks, "\n\n\u001d")


def parse_strategy(value: str | None) -> tuple[int, bool] | None:
    """(depth, contextual) of a chunking option: true, h1 to h5, structured, s1 to s5, or by name; None if off."""
    if not value or value.lower() in ("false", "none", "off"):
        return None
    word = value.lower()
    depth = int(word[-1]) if word[-1].isdigit() else 4
    return depth, word.startswith("s") and word != "simple" or word == "contextual"


def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every page's content at its headings, with level, title and the headings above."""
    pages = table(spark, sf_dir, "formatted_pages").filter("content is not null").dropDuplicates(["page_id"])
    return pages.select("page_id", F.inline(heading_nodes(F.col("content")))).select("page_id", "ord", "level", "title", F.md5("content").alias("content_md5"), F.array_join("parents", "|").alias("parents"))


def contextual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every page at headings up to the second level, each below its context."""
    pages = table(spark, sf_dir, "formatted_pages").filter("content is not null").dropDuplicates(["page_id"])
    return pages.select("page_id", F.posexplode(chunk(F.col("content"), 2, True, F.col("title"))).alias("ord", "chunk")).select("page_id", "ord", F.length("chunk").alias("chunk_length"), F.md5("chunk").alias("chunk_md5"))


QUERIES = {"chunk_headings": chunk_headings, "contextual_chunks": contextual_chunks}
_TRIM = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_LEVELS = ", ".join(f"max(case when level = {k} then ord end) over w as p{k}, max(case when level between 1 and {k - 1} then ord end) over w as s{k}" for k in range(1, 6))
_PARENTS = ", ".join(f"case when p{k} is not null and p{k} > coalesce(s{k}, -1) and (level = 0 or {k} < level) then marks[p{k} + 1] end" for k in range(1, 6))
# the pieces with their level, and of each level the last heading before that no shallower one follows
_PIECES = rf"""with pages as (select page_id, any_value(content) as content, any_value(title) as page_title from formatted_pages where content is not null group by page_id),
cut as (select page_id, page_title, string_split(regexp_replace(content, '\n(#{{1,6}} )', chr(1) || '\1', 'g'), chr(1)) as parts from pages),
pieces as (select page_id, page_title, unnest(range(0, len(parts))) as ord, unnest(parts) as piece from cut),
fronts as (select *, regexp_replace(piece, '^\s+', '') as front from pieces),
heads as (select *, rtrim(regexp_extract(front, '^(#[^\n]*)\n', 1)) as mark from fronts),
levels as (select *, length(regexp_extract(mark, '^(#{{1,6}})', 1)) as level from heads),
open as (select *, list(mark) over (partition by page_id order by ord rows between unbounded preceding and unbounded following) as marks, {_LEVELS} from levels
  window w as (partition by page_id order by ord rows between unbounded preceding and 1 preceding)),
nodes as (select *, list_filter([{_PARENTS}], lambda x: x is not null) as parents,
  case when level > 0 then regexp_replace(front, '\s+$', '') else piece end as content, case when level > 0 then {_TRIM % "substr(front, length(mark) + 1)"} else piece end as body from open)
"""
ORACLE = {
    "chunk_headings": _PIECES + r"""select page_id, cast(ord as integer) as ord, cast(level as integer) as level, case when level > 0 then regexp_replace(mark, '^#{1,6}\s*', '') end as title, md5(content) as content_md5, array_to_string(parents, '|') as parents from nodes""",
    "contextual_chunks": _PIECES + rf"""
, starts as (select *, not (level = 0 and piece <> '') and level <= 2 as starts from nodes),
groups as (select *, sum(starts::int) over (partition by page_id order by ord) as g, list_filter(['# ' || coalesce(page_title, '')] || parents || [mark], lambda x: x <> '') as head from starts),
texts as (select *, max(g) over (partition by page_id) as last_g, case when starts then array_to_string(list_filter(head, lambda x, i: list_position(head, x) = i), chr(10)) || chr(10) || chr(10) || {_TRIM % "body"} else content end as text from groups),
chunks as (select page_id, g, {_TRIM % "coalesce(case when g = last_g then string_agg(nullif(text, ''), chr(10) order by ord) else string_agg(nullif(text, ''), chr(10) || chr(10) order by ord) end, '')"} as chunk from texts group by page_id, g, last_g),
kept as (select * from chunks where chunk <> '')
select page_id, cast(row_number() over (partition by page_id order by g) - 1 as integer) as ord, cast(length(chunk) as integer) as chunk_length, md5(chunk) as chunk_md5 from kept""",
}
