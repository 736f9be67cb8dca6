"""Problem 5: the article of a page, without its site's template.

The template of a host is deduced from the equivalence classes of its pages' tokens.

1. Tokens are lines: by their visible text, and, for lines that are links, trails or by-lines, by their shape with words and
   numbers as slots. Each has an occurrence vector over the host's distinct pages (copies of a page count once).
2. Tokens with equal vectors form a class. A class is large if it has two tokens or more. It is valid if its tokens keep one order;
   the tokens of a class that doesn't are classes of their own. Large classes need less support than single tokens do.
3. The root of the template is the page with its title heading, which leaves two slots, before and after the title. A class is nested
   in the slot in which it occurs; one without a fixed slot, and one whose tokens fill a data slot of the host's markup, isn't part of the
   template. Data slots are the element paths in `html` most of whose text isn't a token.
4. A page is read along the template: tokens of nested classes in their slots, what directly follows one of them (a slot of that
   class: comments, lists of links), and the root's slot before the title are outside. What remains in the root's slot after the
   title is the article.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.llm.residue import is_residue, train
from pagewright.storage import bounded_broadcast, staged, table

#: Least share of a host's pages, and least pages: for a single line, for shapes and for tokens of large classes.
LINE_SHARE, CLASS_SHARE, LEAST = 0.15, 0.03, 4
#: Share of a class's pages that have its commonest order, of a token's pages that have it in one slot of the root.
ORDER_SHARE, SLOT_SHARE = 0.9, 0.9
#: Share of the text in a data slot, at most, that is tokens; share of a token's places in markup that fill data slots, from which on it is data.
FILLED, FILLING = 0.5, 0.5
#: Words up to which a line has a shape.
SHAPE_WORDS = 14

_LINK = re.compile(r"!?\[[^\]]*\]\([^)]*\)")
_LINK_TEXT = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_WORD = re.compile(r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*")
_RUN = re.compile(r"w(?:[\s,.&]*w)*")
_TRAIL = re.compile("[›»·•→‹]")
_MARKS = re.compile(r"^(?:#{1,6}\s+|[*+\-]\s+|\d+[.)]\s+|>\s*)+")
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style|head|template)\b.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9-]*)([^<>]*)>|([^<]+|<)", re.S | re.I)
TEXT, BLANK, BLOCK, HEADING = range(4)
SHAPE = 9
# Elements that don't end a run of text, and ones that end themselves.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tags are often missing: a new one ends the one before.
UNCLOSED = set("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())


def _hash(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) >> 1) or 1


def token_key(text: str, heading: bool) -> int:
    """Key of a line's visible text, 0 if it has too few letters."""
    normal = re.sub(r"\d+", "0", " ".join(text.lower().split()))
    return _hash(("#" if heading else "") + normal) if sum(map(str.isalpha, normal)) >= 2 else 0


def visible(line: str) -> str:
    """A markdown line without its marks and link targets."""
    return _LINK_TEXT.sub(r"\1", _MARKS.sub("", line)).replace("*", "").replace("`", "")


def line_shape(line: str) -> str | None:
    """Shape of a line of links, a trail or a by-line, else None."""
    line = line.lstrip("*-+ \t").strip().lower()
    if not line or line.startswith(("![", ">")) or "«" in line:
        return None
    linked, n = _LINK.subn("\x01", line)
    if not n and not _TRAIL.search(line):
        return None
    words = len(_WORD.findall(linked))
    if n and words > 6 or not n and (words > SHAPE_WORDS or line[-1] in ".!?。！？"):
        return None
    return _RUN.sub("w", re.sub(r"\d+", "0", _WORD.sub("w", linked)))


def parse(content: str) -> tuple[list[int], list[int], list[int], int]:
    """(key, shape key, kind) of each line, and the number of the title heading or -1; keys are 0 where a line can't be a token."""
    keys, shapes, kinds, fence, top = [], [], [], False, -1
    for number, line in enumerate(content.split("\n")):
        s = line.strip()
        mark = s.startswith(("```", "~~~"))
        if not s:
            kind = BLANK
        elif fence or mark or s.startswith(("|", "![")):
            kind = BLOCK
        else:
            kind = HEADING if s.startswith("#") else TEXT
        fence ^= mark
        key = shape = 0
        if kind in (TEXT, HEADING):
            if top < 0 and s.startswith("# "):
                top = number
            key = token_key(visible(s), kind == HEADING)
            if kind == TEXT and (found := line_shape(s)):
                shape = _hash("\x02" + found)
        keys.append(key)
        shapes.append(shape)
        kinds.append(kind)
    return keys, shapes, kinds, top


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, site, title, keys, shapes, kinds, top): lines of each page; title is a key of the heading, or of the text without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, columns = [], ([], [], [], [])
            for content in batch.column(2).to_pylist():
                found = parse(content)
                for c, x in zip(columns, found, strict=True):
                    c.append(x)
                title = content.split("\n")[found[3]] if found[3] >= 0 else content
                titles.append(_hash(" ".join(title.lower().split())))
            types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page_id", "site", "title", "keys", "shapes", "kinds", "top"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), site_of(F.col("url")).alias("site"), "content").filter("content is not null and site is not null")
    return rows.mapInArrow(run, "page_id long, site string, title long, keys array<long>, shapes array<long>, kinds array<tinyint>, top int")


def markup_texts(html: str) -> Iterator[tuple[int, int]]:
    """(key, path) of each run of text in the markup; path is a key of the open block elements with their attributes."""
    stack: list[tuple[str, int]] = [("", 1)]
    text: list[str] = []
    for m in _TAG.finditer(html):
        closing, name, attributes, plain = m.group(2, 3, 4, 5)
        if plain is not None:
            text.append(plain)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if run := "".join(text):
            text.clear()
            if key := token_key(markup.unescape(run), stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit()):
                yield key, stack[-1][1]
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if stack[-1][0] == name and name in UNCLOSED:
                stack.pop()
            stack.append((name, _hash(f"{stack[-1][1]} {name} {' '.join(attributes.split())}")))
    if run := "".join(text):
        if key := token_key(markup.unescape(run), False):
            yield key, stack[-1][1]


def data_fillers(snapshots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(site, token) of the candidates whose text, in the markup of the host's pages, mostly fills data slots.

    snapshots: url, html. Nulls and empty markup say nothing. The texts are counted before they are shuffled: all that are no candidate
    make up one row for each path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, keys, paths = [], [], []
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key, path in markup_texts(html):
                    sites.append(site)
                    keys.append(key)
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(keys, pa.int64()), pa.array(paths, pa.int64())], ["site", "key", "path"])

    rows = snapshots.select(site_of(F.col("url")).alias("site"), "html").filter("html is not null and site is not null")
    texts = rows.mapInArrow(run, "site string, key long, path long")
    known = texts.join(candidates.select("site", F.col("token").alias("key"), F.col("token").alias("hit")), ["site", "key"], "left")
    counts = staged(known.groupBy("site", "path", "hit").agg(F.count(F.lit(1)).alias("n")), "paths")
    slots = counts.groupBy("site", "path").agg((F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)) < FILLED * F.sum("n")).alias("data"))
    places = counts.filter("hit is not null").join(slots, ["site", "path"])
    return places.groupBy("site", F.col("hit").alias("token")).agg((F.sum(F.when(F.col("data"), F.col("n")).otherwise(0)) / F.sum("n")).alias("filling")).filter(F.col("filling") > FILLING).select("site", "token")


def host_classes(parsed: DataFrame) -> DataFrame:
    """(site, token, kind, n, n_site, class_id, class_size, valid, slot): tokens with the support of a large class, and their classes.

    valid: whether the class keeps its tokens in order. slot: 0 before the title, 1 after it, 2 if no page of the class has a title heading, null for
    tokens in both. class_size is 1 for the tokens of an invalid class.
    """
    sizes = bounded_broadcast(staged(parsed.groupBy("site").agg(F.count_distinct("title").alias("n_site")), "hosts"))
    line = F.transform("keys", lambda k, i: F.struct(k.alias("token"), F.get("kinds", i).alias("kind"), i.alias("place")))
    shape = F.transform("shapes", lambda k, i: F.struct(k.alias("token"), F.lit(SHAPE).cast("tinyint").alias("kind"), i.alias("place")))
    tokens = parsed.select("site", "title", "top", F.explode(F.filter(F.concat(line, shape), lambda x: x["token"] != 0)).alias("t")).select("site", "title", "top", "t.*")
    enough = lambda n, share: (n >= LEAST) & (n >= share * F.col("n_site"))
    # counts of rows bound the counts of pages from above, and are added up before the shuffle
    likely = tokens.groupBy("site", "token", "kind").agg(F.count(F.lit(1)).alias("n")).join(sizes, "site").filter(enough(F.col("n"), CLASS_SHARE)).select("site", "token", "kind", "n_site")
    likely = bounded_broadcast(staged(likely, "likely"))
    once = tokens.join(likely, ["site", "token", "kind"]).groupBy("site", "token", "kind", "n_site", "title").agg(F.min("place").alias("place"), F.avg(F.when(F.col("top") >= 0, (F.col("place") < F.col("top")).cast("int"))).alias("before"))
    once = staged(once, "once")
    # the occurrence vector over distinct pages: its size and the sum of its pages' hashes
    vectors = once.groupBy("site", "token", "kind", "n_site").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("title").cast("decimal(38,0)")).alias("vector"), F.avg("before").alias("before"))
    vectors = vectors.filter(enough(F.col("n"), CLASS_SHARE)).withColumn("class_id", F.xxhash64("n", "vector")).drop("vector")
    vectors = staged(vectors, "vectors")
    classes = vectors.groupBy("site", "class_id").agg(F.count(F.lit(1)).alias("class_size"))
    large = bounded_broadcast(staged(vectors.join(classes.filter("class_size > 1"), ["site", "class_id"]).select("site", "token", "kind", "class_id"), "large"))
    # the order of a class on each of its pages; a page holds at most its own tokens
    orders = once.join(large, ["site", "token", "kind"]).groupBy("site", "class_id", "title").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "token"))), lambda x: x["token"])).alias("order"))
    orders = orders.groupBy("site", "class_id", "order").agg(F.count(F.lit(1)).alias("n")).groupBy("site", "class_id").agg((F.max("n") >= ORDER_SHARE * F.sum("n")).alias("valid"))
    found = vectors.join(classes, ["site", "class_id"]).join(orders, ["site", "class_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(True)))
    slot = F.when(F.col("before").isNull(), 2).when(F.col("before") >= SLOT_SHARE, 0).when(F.col("before") <= 1 - SLOT_SHARE, 1)
    return found.withColumn("class_size", F.when(F.col("valid"), F.col("class_size")).otherwise(1)).withColumn("slot", slot).drop("before")


def host_templates(parsed: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(site, token, slot, class_id, class_size): the tokens of each host's template with the root's slot that their class is nested in.

    snapshots (url, html): markup of the hosts' pages; without it, no class is dropped as data.
    """
    classes = staged(host_classes(parsed), "classes")
    share = F.when((F.col("kind") == SHAPE) | (F.col("class_size") > 1), CLASS_SHARE).otherwise(LINE_SHARE)
    nested = classes.filter((F.col("n") >= share * F.col("n_site")) & F.col("slot").isNotNull())
    if snapshots is not None:
        nested = staged(nested, "nested")
        lines = bounded_broadcast(nested.filter(F.col("kind") != SHAPE).select("site", "token").distinct(), sized_by=nested)
        nested = nested.join(bounded_broadcast(data_fillers(snapshots, lines), sized_by=nested), ["site", "token"], "left_anti")
    return nested.select("site", "token", "slot", "class_id", "class_size")


def outside_lines(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """(page_id, line_no) of every non-blank line outside the article."""
    rows = staged(templates.select("site", "token", "slot"), "tokens")
    by_site = rows.groupBy("site").agg(F.collect_set(F.struct("slot", "token")).alias("template"))  # at most 1 / share tokens for each line of a page
    joined = parsed.join(bounded_broadcast(by_site, sized_by=rows), "site", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], ...]] = {}
        for batch in batches:
            pages, lines = [], []
            for i in range(batch.num_rows):
                site = batch.column("site")[i].as_py()
                if site not in known:
                    if len(known) > 5000:
                        known.clear()
                    found = batch.column("template")[i].as_py() or ()
                    # before the title, after it, and on pages without a title heading, which are one slot
                    known[site] = tuple({x["token"] for x in found if slot is None or x["slot"] in (slot, 2)} for slot in (0, 1, None))
                slots, top, opened = known[site], batch.column("top")[i].as_py(), False
                page = batch.column("page_id")[i].as_py()
                columns = zip(*(batch.column(c)[i].as_py() for c in ("keys", "shapes", "kinds")), strict=True)
                for number, (key, shape, kind) in enumerate(columns):
                    if kind == BLANK:
                        opened = False
                        continue
                    if number == top:
                        opened = False
                        continue  # the root's own token
                    template = slots[2 if top < 0 else number > top]
                    held = key in template
                    if held:
                        opened = True  # what follows without a blank line fills a slot of the token's class
                    if number < top or held or shape in template or (opened and kind == TEXT):
                        pages.append(page)
                        lines.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(lines, pa.int32())], ["page_id", "line_no"])

    return joined.select("page_id", "site", "keys", "shapes", "kinds", "top", "template").mapInArrow(run, "page_id long, line_no int").distinct()


def main_bodies(pages: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(page_id, content): each page's article.

    pages: page_id, url, content; snapshots: url, html; other columns are ignored. Null contents stay null; pages without a site keep
    their content; repeated rows give one row; blank lines stay where they are.
    """
    found = outside_lines(parsed := staged(parsed_pages(pages), "parsed"), host_templates(parsed, snapshots))
    drop = found.groupBy(F.col("page_id").alias("_page")).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda x, i: ~F.coalesce(F.array_contains("_drop", i.cast("int")), F.lit(False))), "\n")
    once = pages.select("page_id", "content").dropDuplicates(["page_id"])
    return once.join(drop, F.col("page_id") == F.col("_page"), "left").select("page_id", kept.alias("content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no) of every non-blank line outside the article, of pages that aren't residue."""
    weights = train(spark, sf_dir)
    pages = table(spark, sf_dir, "formatted_pages").select("page_id", "url", "content", "title")
    parsed = staged(parsed_pages(pages.filter(~is_residue(F.col("content"), weights, F.col("title")))), "parsed")
    return outside_lines(parsed, host_templates(parsed, table(spark, sf_dir, "snapshots").select("url", "html")))


def p5_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's article."""
    return main_bodies(table(spark, sf_dir, "formatted_pages").select("page_id", "url", "content"), table(spark, sf_dir, "snapshots").select("url", "html"))


QUERIES = {"p5_found": p5_found, "p5_articles": p5_articles}
