"""Problem 3: template residue, filler text, error pages and notices that scripts are required.

A regularised linear classifier (three classes: text, placeholder or filler, message) reads hashed n-grams of words, marks and
kinds of marks, the segment's length and its place in the record, and the record's title: its words, and how many of them the text holds. Its labels are weak: response status and fixed
phrases, on a bounded sample of records from the training hosts. It is validated on all records of hosts it hasn't seen. Every segment of every
record is classified; a record is residue if it holds a placeholder or filler segment, or if messages make up most of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.llm.tokens import DIGIT, LETTER, MARK, NEWLINE, WIDE, joined, kinds, words
from pagewright.storage import staged, table

#: Bits of the hashed feature space, most records of the labelled sample, share of hosts kept for validation, L2 weight.
BITS, SAMPLE, HELD_OUT, L2 = 17, 4000, 0.2, 2e-5
#: Records, at most, among which the sample is looked for.
LOOKED_AT = 30_000
#: Share of a record's letters that messages make up in a message record.
MESSAGE_SHARE = 0.5
TEXT, FILLER, MESSAGE, QUOTED = 0, 1, 2, 3  # QUOTED is a label only; it trains as TEXT, with a weight of its own

# Phrases of weak labels, in lower case.
FILLER_PHRASES = [
    "lorem ipsum", "dolor sit amet", "sample text sample", "your text goes here", "replace this paragraph", "insert text here", "text goes here", "dummy text", "placeholder text",
    "hier steht ihr text", "blindtext", "hier kommt der text", "texto de ejemplo", "aquí va el texto", "sustituya este párrafo", "votre texte ici", "texte à remplacer", "remplacez ce paragraphe",
    "insira o texto", "testo di esempio", "здесь будет текст", "текст-заполнитель", "замените этот абзац", "ここに本文", "ダミーテキスト", "サンプルテキスト", "此处输入", "示例文本", "此处填写",
    "xxxx xxx xxxx", "xxxxx xxx xxxxxxx", "asdf asdf", "foo bar baz",
]
MESSAGE_PHRASES = [
    "enable javascript", "requires javascript", "javascript is disabled", "turn on scripts", "does not run scripts", "activa javascript", "activer javascript", "javascript ist deaktiviert", "включите javascript", "スクリプトを有効", "启用浏览器脚本", "ative o javascript", "abilita javascript",
    "404 not found", "not found", "page not found", "can't find the page", "could not be found", "page introuvable", "n'existe plus", "seite nicht gefunden", "gibt es nicht", "página no encontrada", "página não encontrada", "pagina non trovata", "страница не найдена", "ページが見つかりません", "页面不存在", "找不到页面",
    "access denied", "do not have permission", "forbidden", "zugriff verweigert", "accès refusé", "acceso denegado", "доступ запрещ", "bad gateway", "internal server error", "something went wrong", "service unavailable", "temporarily unavailable", "carrying out maintenance", "wartungsarbeiten", "en maintenance", "en mantenimiento", "メンテナンス中",
    "too many requests", "slow down and try again", "checking your browser", "account has been suspended", "fatal error", "database connection failed", "call to undefined function", "verbindung zum server ist fehlgeschlagen", "error code", "request id", "try again later", "loading…", "gateway time",
]
#: Words around a placeholder or phrase in an article that explains or quotes it.
QUOTING_PHRASES = ["placeholder", "such as", "writing", "the words", "says", "explains", "for example", "called", "known as", "notice", "zum beispiel", "par exemple", "por ejemplo", "например", "selon", "según", "laut"]
#: Markup of a placeholder: {{ x }}, {% x %}, ${x}, <%= x %>, [[x]], @@x@@, %x%, #x#, {x}, [INSERT X HERE].
PLACEHOLDER = re.compile(r"\{\{\s*[\w.]+\s*\}\}|\{%\s*[\w.]+\s*%\}|@@[\w.]+@@|#[a-z][\w.]+#|\$\{\s*[\w.]+\s*\}|<%=?\s*[\w.]+\s*%>|\[\[\s*[\w.]+\s*\]\]|%[a-z][\w.]+%|(?<![\w$({])\{[a-z][\w.]*\}|\[insert [^\]\n]{1,40}\]")
#: Latin words of filler text.
_LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit donec vel ante quis nulla porta augue purus ligula metus risus sapien tempor turpis massa magna felis eros justo odio arcu diam nisl vero labor mauris sed ut et".split())

_LATIN_WORD = re.compile(r"\b(?:" + "|".join(sorted(_LATIN)) + r")\b")


def segments(codes: np.ndarray) -> np.ndarray:
    """Number of each character's segment: a line, or a sentence in it."""
    kind = kinds()[codes]
    cut = kind == NEWLINE
    stop = (codes == 46) | (codes == 33) | (codes == 63)
    cut[:-1] |= stop[:-1] & (kind[1:] != LETTER) & (kind[1:] != DIGIT) & (kind[1:] != MARK)
    cut |= (codes == 0x3002) | (codes == 0xFF01) | (codes == 0xFF1F)
    return np.concatenate([[0], np.cumsum(cut)[:-1]])


def title_share(title: str | None, text: str) -> int:
    """How many of the title's words the text holds, in quarters; 5 without a title."""
    title_words = (title or "").lower().split()
    if not title_words:
        return 5
    low = text.lower()
    return 4 * sum(w in low for w in title_words) // len(title_words)


def features(texts: list[str], titles: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, segment of the feature, text of the segment, letters of the segment, first character of the segment)."""
    codes, firsts = joined(texts)
    of = segments(codes)
    begins, ends, hashes, kind = words(codes)
    n = int(of[-1]) + 1 if len(of) else 0
    first_char = np.searchsorted(of, np.arange(n))
    text_of = np.searchsorted(firsts, first_char, "right") - 1
    is_letter = np.isin(kinds()[codes], (LETTER, WIDE))
    letters = np.bincount(of, is_letter, n).astype(int)
    per_text = np.bincount(text_of, letters, len(texts))
    seg = of[begins]
    mask = np.uint64((1 << BITS) - 1)
    with np.errstate(over="ignore"):
        pair = (seg[1:] == seg[:-1]) if len(seg) else np.empty(0, bool)
        rough = np.where(kind == MARK, hashes, kind.astype(np.uint64))  # marks by themselves, all else by kind
        touch = (begins[1:] == ends[:-1]).astype(np.uint64) if len(seg) else np.empty(0, np.uint64)
        two = (hashes[:-1] * np.uint64(31) + hashes[1:]) * np.uint64(0x9E3779B1)
        shape = (rough[:-1] * np.uint64(37) + rough[1:] * np.uint64(3) + touch) * np.uint64(0x85EBCA77)
        three = (rough[:-2] * np.uint64(41) + rough[1:-1] * np.uint64(5) + rough[2:]) * np.uint64(0xC2B2AE3D)
        both = pair[1:] & pair[:-1]
        mixed_shape = pair & ((kind[:-1] == MARK) | (kind[1:] == MARK)) if len(seg) else pair
        mixed_three = both & ((kind[:-2] == MARK) | (kind[1:-1] == MARK) | (kind[2:] == MARK)) if len(seg) > 1 else both
        # length and place of each segment: its size, its record's, and whether it is the record's first
        size = np.minimum(7, np.log2(letters + 1)).astype(np.uint64)
        whole = np.minimum(12, np.log2(per_text[text_of] + 1)).astype(np.uint64)
        first = np.concatenate([[True], text_of[1:] != text_of[:-1]]).astype(np.uint64) if n else np.empty(0, np.uint64)
        extra = [size + np.uint64(1000), whole * np.uint64(16) + np.uint64(2000), whole * np.uint64(32) + size * np.uint64(2) + first + np.uint64(5000)]
        # how far the record's title speaks of the same thing as its text, by the record's size
        shares = np.array([title_share(t, x) for t, x in zip(titles, texts, strict=True)] if titles else [5] * len(texts), np.uint64)
        extra.append(whole * np.uint64(8) + shares[text_of] + np.uint64(9000))
        # words of the title, on the record's first segment
        title_codes, title_firsts = joined([t or "" for t in titles or texts[:0]])
        title_begins, _, title_hashes, _ = words(title_codes)
        title_of = np.searchsorted(title_firsts, title_begins, "right") - 1
        first_of = np.searchsorted(text_of, title_of)
    numbers = [hashes, two[pair], shape[mixed_shape], three[mixed_three], *extra, title_hashes]
    places = [seg, seg[1:][pair], seg[1:][mixed_shape], seg[2:][mixed_three] if len(seg) > 1 else seg[:0], *[np.arange(n)] * 4, first_of]
    salt = np.uint64(0xFF51AFD7ED558CCD)
    with np.errstate(over="ignore"):
        out = np.concatenate([((x ^ np.uint64(i * 977)) * salt) >> np.uint64(64 - BITS) for i, x in enumerate(numbers)]) & mask
    return out.astype(np.int32), np.concatenate(places).astype(np.int32), text_of, letters, first_char


def scores(weights: np.ndarray, feature: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of weights by segment and class, scaled by the number of features."""
    counts = np.bincount(place, minlength=n)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    return np.stack([np.bincount(place, weights[feature, k], n) * scale for k in range(weights.shape[1])], 1)


def fit(texts: list[str], statuses: list[int | None], titles: list[str | None] | None = None, rounds: int = 100, rate: float = 2.0) -> np.ndarray:
    """Weights (feature, class) of the softmax regression, by gradient descent with momentum; the bias is a feature."""
    weights = np.zeros((1 << BITS, 3), np.float32)
    parts = []  # some texts at a time, for the driver's memory
    for at, end in _runs(texts):
        own = titles[at:end] if titles else None
        feature, place, text_of, letters, first_char = features(texts[at:end], own)
        parts.append((feature, place, segment_labels(texts[at:end], statuses[at:end], text_of, letters, first_char)))
    sizes = np.cumsum([0, *(len(labels) for _, _, labels in parts)])
    feature = np.concatenate([f for f, _, _ in parts]) if parts else np.empty(0, np.int32)
    place = np.concatenate([p + k for (_, p, _), k in zip(parts, sizes[:-1], strict=True)]).astype(np.int32) if parts else np.empty(0, np.int32)
    labels = np.concatenate([x for _, _, x in parts]) if parts else np.empty(0, int)
    del parts
    use = np.flatnonzero(labels >= 0)
    if not len(use):
        return weights
    number = np.full(len(labels), -1)
    number[use] = np.arange(len(use))
    keep = number[place] >= 0
    feature, place, y = feature[keep], number[place[keep]].astype(np.int32), labels[use]
    n = len(use)
    share = np.bincount(y, minlength=4) / n
    balance = np.where(share > 0, np.minimum(100, 1 / (4 * np.maximum(share, 1e-9))), 0)[y]
    balance /= balance.sum()
    y = np.where(y == QUOTED, TEXT, y)
    # both products with the sparse matrix of features go along runs: by segment, and by feature
    place, feature = _sorted_by(place, feature)
    columns, feature = np.unique(feature, return_inverse=True)
    by_feature = np.argsort(feature, kind="stable")
    rows_of = place[by_feature]
    row_starts, column_starts = np.flatnonzero(np.diff(place, prepend=-1)), np.flatnonzero(np.diff(feature[by_feature], prepend=-1))
    filled = place[row_starts]
    scale = (1 / np.sqrt(np.maximum(np.bincount(place, minlength=n), 1))).astype(np.float32)[:, None]
    step = (balance[:, None] * n).astype(np.float32) * scale
    target = np.eye(3, dtype=np.float32)[y]
    own = np.zeros((len(columns), 3), np.float32)
    square = np.zeros_like(own)
    z = np.zeros((n, 3), np.float32)
    for _ in range(rounds):
        for k in range(3):
            z[filled, k] = np.add.reduceat(own[:, k][feature], row_starts)
        p = np.exp(z * scale - (z * scale).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * step
        gradient = np.stack([np.add.reduceat(g[:, k][rows_of], column_starts) for k in range(3)], 1) / n + L2 * own
        square += gradient * gradient
        own -= rate * gradient / (np.sqrt(square) + 1e-8) * 0.1
    weights[columns] = own
    return weights


def _sorted_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _held_by(whole: str, phrases: list[str], owner: Callable[[list[int]], np.ndarray], n: int) -> np.ndarray:
    """Which of n stretches of a lower-cased text hold one of the phrases; owner tells the stretch of each position."""
    places = []
    for phrase in phrases:
        at = whole.find(phrase)
        while at >= 0:
            places.append(at)
            at = whole.find(phrase, at + 1)
    out = np.zeros(n, bool)
    out[owner(places)] = True
    return out


def segment_labels(texts: list[str], statuses: list[int | None], text_of: np.ndarray, letters: np.ndarray, first_char: np.ndarray) -> np.ndarray:
    """Weak label of each segment, -1 for those that should not train: QUOTED is text that quotes."""
    # a few characters change their number when lower-cased, which would move all places after them
    whole = "".join(low if len(low := c.lower()) == 1 else c for t in texts for c in (t, "\n")) if any(len(t.lower()) != len(t) for t in texts) else "\n".join(t.lower() for t in texts) + "\n"
    n = len(text_of)
    per_text = np.bincount(text_of, letters, len(texts)).astype(int)
    segment = lambda places: np.searchsorted(first_char, np.array(places, int), "right") - 1
    record = lambda places: text_of[segment(places)] if places else np.empty(0, int)
    filler = _held_by(whole, FILLER_PHRASES, segment, n)
    filler[segment([m.start() for m in PLACEHOLDER.finditer(whole)])] = True
    quoted = _held_by(whole, QUOTING_PHRASES, segment, n)
    phrased = _held_by(whole, MESSAGE_PHRASES, segment, n)
    message = _held_by(whole, MESSAGE_PHRASES, record, len(texts))
    latin = np.bincount(segment([m.start() for m in _LATIN_WORD.finditer(whole)]), minlength=n)
    blanks = np.bincount(segment([m.start() for m in re.finditer(r"\S+", whole)]), minlength=n)
    filler |= (blanks >= 6) & (latin >= 0.6 * blanks)
    failed = np.array([s is not None and s >= 400 for s in statuses], bool)
    small = per_text[text_of] <= 250
    labels = np.where(per_text[text_of] > 350, TEXT, -1)
    labels[phrased] = np.where(quoted | (per_text[text_of] > 600), QUOTED, -1)[phrased]
    labels[small & (message[text_of] | failed[text_of])] = MESSAGE
    labels[filler] = np.where(quoted, QUOTED, FILLER)[filler]
    labels[letters == 0] = -1
    return labels


def host_records(spark: SparkSession, sf_dir: str, held_out: bool) -> DataFrame:
    """(page_id, field, host, text, status, title) of snapshots and pages of training hosts, or of those kept for validation."""
    shots = table(spark, sf_dir, "snapshots").select("page_id", F.lit(0).alias("field"), site_of(F.col("url")).alias("host"), "text", "status", "title")
    pages = table(spark, sf_dir, "formatted_pages").select("page_id", F.lit(1).alias("field"), site_of(F.col("url")).alias("host"), F.col("content").alias("text"), F.lit(None).cast("int").alias("status"), "title")
    kept = F.pmod(F.xxhash64(F.coalesce("host", F.lit(""))), F.lit(1000)) < int(1000 * HELD_OUT)
    return shots.unionByName(pages).filter(kept if held_out else ~kept)


def training_sample(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[int | None], list[str | None]]:
    """At most SAMPLE texts of snapshots, with their status, and contents of pages, with their titles, of training hosts.

    Half of the sample, at most, are records that weak labels call residue; the order is that of a hash of the id, and about LOOKED_AT
    records are searched.
    """
    n = sum(table(spark, sf_dir, name).count() for name in ("snapshots", "formatted_pages"))  # the files hold their numbers of rows
    share = min(1.0, LOOKED_AT / max(1, n))
    records = host_records(spark, sf_dir, False)
    records = records.withColumn("h", F.xxhash64("page_id", "field", F.lit(7))).filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    records = records.filter("text is not null")
    text = F.lower("text")
    marked = text.rlike(_java(PLACEHOLDER.pattern)) | text.rlike("|".join(map(re.escape, [*FILLER_PHRASES, *QUOTING_PHRASES[:3]]))) | ((F.length("text") < 400) & ((F.col("status") >= 400) | text.rlike("|".join(map(re.escape, MESSAGE_PHRASES)))))
    # the ids are chosen first, from a narrow table, so that no more texts than the sample's come to the driver
    keys = staged(records.select("h", "page_id", "field", marked.alias("marked")), "sample")
    ids: set[tuple[int, int]] = set()
    for part in (keys.filter("marked"), keys):
        ids |= {(r["page_id"], r["field"]) for r in part.select("h", "page_id", "field").orderBy("h", "page_id", "field").limit(SAMPLE // 2).collect()}
    chosen = F.broadcast(spark.createDataFrame(sorted(ids), "page_id long, field int"))  # at most SAMPLE rows
    rows = records.join(chosen, ["page_id", "field"], "left_semi").select("h", "field", "text", "status", "title").dropDuplicates(["h"]).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["field"], r["text"]))
    return [r["text"] for r in rows], [r["status"] for r in rows], [r["title"] for r in rows]


def _java(pattern: str) -> str:
    return pattern.replace(r"[\w$({]", r"[\w$(\{]")


_TRAINED: dict[tuple, np.ndarray] = {}


def train(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Weights fitted on the sample; an application fits them once for the same files, which their sizes and times of change tell."""
    files: list = [spark.sparkContext.applicationId]
    for name in ("snapshots", "formatted_pages"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            files.append((file, status.getLen(), status.getModificationTime()))
    if (key := tuple(files)) not in _TRAINED:
        _TRAINED.clear()
        texts, statuses, titles = training_sample(spark, sf_dir)
        _TRAINED[key] = fit(texts, statuses, titles)
    return _TRAINED[key]


def _runs(texts: list[str], chunk: int = 400_000) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts with about `chunk` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def classify(texts: list[str], weights: np.ndarray, titles: list[str | None] | None = None, chunk: int = 400_000) -> np.ndarray:
    """(letters, filler segments' letters, message segments' letters) of each text; whole texts, many at a time."""
    out = np.zeros((len(texts), 3))
    for at, end in _runs(texts, chunk):
        feature, place, text_of, letters, _ = features(texts[at:end], titles[at:end] if titles else None)
        n = len(text_of)
        best = scores(weights, feature, place, n).argmax(1) if n else np.empty(0, int)
        for k, weight in ((0, letters), (1, np.where(best == FILLER, letters, 0)), (2, np.where(best == MESSAGE, letters, 0))):
            out[at:end, k] = np.bincount(text_of, weight, end - at)
    return out


def is_residue(text: Column, weights: np.ndarray, title: Column | None = None) -> Column:
    """Whether the classifier calls a record residue; false for null and blank texts. A null title is one of the features."""
    shared = SparkSession.active().sparkContext.broadcast(weights.astype(np.float16))  # 2^17 x 3 x 2 bytes

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = shared.value.astype(np.float32)
        for batch, titles in batches:
            r = classify([t or "" for t in batch], own, [t or None for t in titles])
            yield pd.Series((r[:, 1] > 0) | ((r[:, 0] > 0) & (r[:, 2] >= MESSAGE_SHARE * r[:, 0])))

    return run(text, F.lit(None).cast("string") if title is None else title)


def residue(records: DataFrame, id_column: str, text_column: str, weights: np.ndarray, title_column: str | None = None) -> DataFrame:
    """(id) of every residue record. Null, empty and blank texts are none; repeated rows give one id; other columns are ignored."""
    title = (F.col(title_column) if title_column else F.lit(None).cast("string")).alias("_title")
    return records.select(F.col(id_column), F.col(text_column).alias("_text"), title).filter(is_residue(F.col("_text"), weights, F.col("_title"))).select(id_column).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, page_id) of every text and content that is residue."""
    weights = train(spark, sf_dir)
    texts = residue(table(spark, sf_dir, "snapshots"), "page_id", "text", weights, "title")
    contents = residue(table(spark, sf_dir, "formatted_pages"), "page_id", "content", weights, "title")
    return texts.select(F.lit("snapshots.text").alias("field_name"), "page_id").unionByName(contents.select(F.lit("formatted_pages.content").alias("field_name"), "page_id"))


def confusion(records: DataFrame, weights: np.ndarray) -> DataFrame:
    """(label, predicted, n_segments): weak labels and predictions of every labelled segment of records (text, status, title)."""
    shared = records.sparkSession.sparkContext.broadcast(weights.astype(np.float16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value.astype(np.float32), ["text", "filler", "message"]
        for batch in batches:
            texts, statuses, titles = (batch.column(c).to_pylist() for c in ("text", "status", "title"))
            n = np.zeros(9, int)
            for at, end in _runs(texts):
                feature, place, text_of, letters, first_char = features(texts[at:end], titles[at:end])
                labels = segment_labels(texts[at:end], statuses[at:end], text_of, letters, first_char)
                best = scores(own, feature, place, len(text_of)).argmax(1)
                known = np.where(labels == QUOTED, TEXT, labels)
                n += np.bincount(3 * known[labels >= 0] + best[labels >= 0], minlength=9)
            some = np.flatnonzero(n).tolist()
            yield pa.RecordBatch.from_pydict({"label": pa.array([names[i // 3] for i in some], pa.string()), "predicted": pa.array([names[i % 3] for i in some], pa.string()), "n_segments": pa.array(n[some], pa.int64())})

    found = records.select("text", "status", "title").filter("text is not null").mapInArrow(run, "label string, predicted string, n_segments long")
    return found.groupBy("label", "predicted").agg(F.sum("n_segments").alias("n_segments"))


def p3_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of weak labels and predictions by segment, over all records of hosts that training hasn't seen; repeated rows count once."""
    records = host_records(spark, sf_dir, True).select("page_id", "field", "text", "status", "title").distinct()
    return confusion(records, train(spark, sf_dir)).orderBy("label", "predicted")


QUERIES = {"p3_found": p3_found, "p3_validation": p3_validation}
