"""Problem 4: lines repeated across one site's pages.

Every line is parsed into a template by a token tree of fixed depth: site, number of tokens, first tokens; tokens with digits are
wildcard slots.

1. Each partition grows the trees of its pages and counts the pages at their leaves; the trees are merged by adding up. Leaves that can't
   cover enough pages are cut off.
2. The lines at the leaves left are parsed into one template for each leaf: a position whose token differs between lines is a
   wildcard slot, all others are constants. Templates of partitions are merged position by position, in any order.
3. A template's lines are told apart by what fills its slots. A template with its filling that covers enough distinct pages of its
   site is repeated, and its lines are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.storage import bounded_broadcast, staged, table

#: A line is repeated if it is on at least MIN_PAGES pages of the site and on at least MIN_SHARE of the site's pages.
MIN_PAGES, MIN_SHARE, MIN_LETTERS = 10, 0.15, 10
#: Leading tokens that a path of the tree tells apart.
DEPTH = 3
#: Leaves of a partition's trees that are held in memory; they are merged with others whenever they come.
LEAVES = 200_000

# Unicode white space; str.split() takes four separators more.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = re.compile(f"[{''.join(map(chr, _WHITE))}]+")
_SEPARATOR = re.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")
_DIGITS = re.compile(r"\d+")


def line_tokens(line: str, min_letters: int = MIN_LETTERS) -> list[str] | None:
    """Lower-case tokens of a line with `0` for each run of digits; None if it has too few letters."""
    if sum(map(str.isalpha, line[:80])) < min_letters and (len(line) <= 80 or sum(map(str.isalpha, line)) < min_letters):
        return None
    line = _DIGITS.sub("0", line.lower())
    return [t for t in _SPACE.split(line) if t] if _SEPARATOR.search(line) else line.split()


def tree_path(tokens: list[str], depth: int = DEPTH) -> int:
    """Key of the path from the site's root to a leaf: number of tokens, then the first `depth` tokens, wildcards for those with digits."""
    return xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join('<*>' if '0' in t else t for t in tokens[:depth])}") >> 1


def site_rows(pages: DataFrame, text: str, url: str, page: str) -> DataFrame:
    """(site, page_id, text) of the pages that have a site and a text."""
    return pages.select(site_of(F.col(url)).alias("site"), F.col(page).alias("page_id"), F.col(text).alias("text")).filter("site is not null and text is not null")


def tree_leaves(rows: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(site, path, n): the merged trees' leaves with their number of rows, which is at least that of distinct pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict[int, int]] = {}
        size = 0

        def grown() -> pa.RecordBatch:
            leaves = [(site, path, n) for site, tree in trees.items() for path, n in tree.items()]
            trees.clear()
            columns = list(zip(*leaves, strict=True)) if leaves else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["site", "path", "n"])

        for batch in batches:
            for site, text in zip(batch.column("site").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tree = trees.setdefault(site, {})
                before = len(tree)
                for path in {tree_path(t) for line in text.split("\n") if (t := line_tokens(line, min_letters))}:
                    tree[path] = tree.get(path, 0) + 1
                size += len(tree) - before
                if size > LEAVES:
                    size = 0
                    yield grown()
        yield grown()

    return rows.select("site", "text").mapInArrow(run, "site string, path long, n long").groupBy("site", "path").agg(F.sum("n").alias("n"))


def leaf_lines(rows: DataFrame, leaves: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(site, path, page_id, line_no, tokens): the lines at the given leaves (site, path), a key for each token."""
    trees = leaves.groupBy("site").agg(F.collect_set("path").alias("tree"))  # a page's lines over the least share of pages, at most
    joined = rows.join(bounded_broadcast(trees, sized_by=leaves), "site").withColumn("page_id", F.col("page_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, (site, page, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("site", "page_id", "text")), strict=True)):
                if site not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[site] = set(batch.column("tree")[i].as_py())
                tree = known[site]
                for number, line in enumerate(text.split("\n")):
                    if (tokens := line_tokens(line, min_letters)) and (path := tree_path(tokens)) in tree:
                        for column, x in zip(out, (site, path, page, number, [xxhash.xxh3_64_intdigest(t) >> 1 for t in tokens]), strict=True):
                            column.append(x)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["site", "path", "page_id", "line_no", "tokens"])

    return joined.select("site", "page_id", "text", "tree").mapInArrow(run, "site string, path long, page_id long, line_no int, tokens array<long>")


def merged_templates(lines: DataFrame) -> DataFrame:
    """(site, path, slots): the template of each leaf, as the positions of its wildcard slots; all other positions are constants."""
    places = lines.select("site", "path", F.posexplode("tokens").alias("place", "token")).groupBy("site", "path", "place").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    return places.groupBy("site", "path").agg(F.array_sort(F.collect_list(F.when(F.col("low") != F.col("high"), F.col("place")))).alias("slots"))


def site_sizes(pages: DataFrame, url: str = "url", page: str = "page_id") -> DataFrame:
    """(site, n_pages) with distinct pages."""
    return pages.select(site_of(F.col(url)).alias("site"), F.col(page).alias("page_id")).filter("site is not null").groupBy("site").agg(F.count_distinct("page_id").alias("n_pages"))


def repeated_lines(
    pages: DataFrame, text: str = "content", url: str = "url", page: str = "page_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS
) -> DataFrame:
    """(page_id, line_no) of every occurrence of a line that its site repeats.

    Rows with a null or unparsable url, and null or empty texts, have no lines; repeated rows of a page count once.
    Only the named columns are read, so others may clash with any name used here.
    """
    sizes = bounded_broadcast(staged(site_sizes(pages, url, page), "sites"))
    rows = site_rows(pages, text, url, page)
    enough = lambda n: (n >= min_pages) & (n >= min_share * F.col("n_pages"))
    leaves = staged(tree_leaves(rows, min_letters).join(sizes, "site").filter(enough(F.col("n"))).select("site", "path"), "leaves")
    lines = staged(leaf_lines(rows, leaves, min_letters), "lines")
    templates = bounded_broadcast(staged(merged_templates(lines), "templates"))
    # what fills the slots, as one key; a template without slots has one filling
    filled = lines.join(templates, ["site", "path"]).select("site", "path", "page_id", "line_no", F.xxhash64(F.transform("slots", lambda i: F.get("tokens", i))).alias("filling"))
    counts = filled.groupBy("site", "path", "filling").agg(F.count_distinct("page_id").alias("n")).join(sizes, "site")
    found = bounded_broadcast(staged(counts.filter(enough(F.col("n"))).select("site", "path", "filling"), "repeated"))
    return filled.join(found, ["site", "path", "filling"], "left_semi").select("page_id", "line_no").distinct()


def without_repeated_lines(pages: DataFrame, text: str = "content", url: str = "url", page: str = "page_id", **thresholds: float) -> DataFrame:
    """`pages` with the repeated lines taken out of `text`; all other columns stay as they are."""
    found = repeated_lines(pages, text, url, page, **thresholds)
    drop = found.groupBy("page_id").agg(F.collect_set("line_no").alias("_drop")).withColumnRenamed("page_id", "_page")
    joined = pages.join(drop, F.col(page) == F.col("_page"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), i.cast("int"))), "\n")
    return joined.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(kept)).drop("_drop", "_page")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no) of every occurrence of a line that its site repeats."""
    return repeated_lines(table(spark, sf_dir, "formatted_pages").select("page_id", "url", "content"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's content without the lines that its site repeats."""
    pages = table(spark, sf_dir, "formatted_pages").select("page_id", "url", "content")
    return without_repeated_lines(pages.dropDuplicates(["page_id"])).select("page_id", "content")


QUERIES = {"p4_found": p4_found, "p4_cleaned": p4_cleaned}

# The definition in the test data's description, counted directly.
ORACLE = {
    "p4_found": r"""
with pages as (select distinct page_id, url, content from formatted_pages where url is not null and content is not null),
split as (select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') as site,
  string_split(content, chr(10)) as parts from pages),
lines as (select page_id, site, unnest(range(0, len(parts))) as line_no, unnest(parts) as line from split),
normal as (select page_id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') as line
  from lines where length(regexp_replace(line, '\P{L}', '', 'g')) >= 10),
sizes as (select site, count(distinct page_id) as n_pages from split group by site),
counts as (select site, line, count(distinct page_id) as n from normal group by site, line)
select normal.page_id, cast(normal.line_no as integer) as line_no from normal join counts using (site, line) join sizes using (site)
where n >= 10 and n >= 0.15 * n_pages
""",
}
