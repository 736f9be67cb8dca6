"""Problem 2: pages that share most of their text.

Two texts are near-duplicates if the Jaccard similarity of their sets of substrings reaches a threshold. Exact copies form one
class. All distinct substrings of a class take part. They are divided into parts by their hashes: a pair at the threshold reaches
it in one of the parts at least, so that each part can be searched by itself and no pair is lost. In a part, the substrings that the
same classes have (equal inverted lists) become one list with a weight.

Pairs come from a search for T-occurrences over these lists (DivideSkip, `divide_skip`): of each text's lists, the longest are set
aside while they weigh less than the overlap T that it needs; the short ones are merged, and what the merge leaves is looked for in
the long ones by binary search. A part that fits into a task is searched there. A larger one is divided into buckets: its lists are
written, and texts meet at the lists of their prefixes, each meeting being searched in the same way. All pairs found are checked
exactly on their whole texts. Parts of either kind are searched in several passes, so that the disk holds the substrings, lists and
meetings of one pass only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shingles import WIDTH, distinct as sorted_distinct, letters, mix, text_key, window_hashes
from pagewright.storage import bounded_broadcast, discard, staged, table

#: Least characters of a text that takes part, similarity.
MIN_CHARS, THRESHOLD = 300, 0.5
#: Substrings of one bucket, and the most parts (powers of two); beyond that many buckets, several make up a part.
BUCKET, PARTS = 10_000_000, 64
#: Texts of one meeting that a task compares with as many others.
BLOCK = 4000
#: Passes over the texts, each for its share of the parts; fewer use more disk, more hash the texts again.
PASSES = 2
#: The same where parts are divided into buckets: what texts meet with is several times their substrings.
PASSES_AT_LISTS = 8
#: Places in short lists that are merged at a time.
MERGED = 4_000_000


def least_overlap(size: np.ndarray, smaller: bool, threshold: float = THRESHOLD) -> np.ndarray:
    """Least overlap of a set of `size` tokens with any partner at the threshold; smaller: with one of at least its size."""
    s = np.asarray(size, float)
    x = 2 * threshold * s / (1 + threshold) if smaller else threshold * s
    return np.maximum(1, np.ceil(x - 1e-9)).astype(int)


def enough(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether an overlap x of sets of a and b tokens reaches the threshold."""
    return x >= threshold * (a + b - x)


def sketches(texts: DataFrame, buckets: int = 1, min_chars: int = MIN_CHARS, width: int = WIDTH, only: range | None = None) -> DataFrame:
    """(bucket, cls, size, lost, tokens): all distinct substrings of each text with at least `min_chars` letters and digits.

    buckets: a power of two; only: the buckets that are wanted, if not all. cls is a 64-bit key of the normalised text, size the number of its substrings in the bucket's part,
    tokens the 32 bits of their hashes that follow the bucket's, and lost the number of those in the part that fell together by
    that. A class may come again from another partition.
    """
    bits, coarse = buckets.bit_length() - 1, (buckets // min(buckets, PARTS)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at, classes, sizes, lost, tokens = [], [], [], [], []
            for text in batch.column(0):
                if (text := text.as_py()) is None or len(text) < min_chars:
                    continue
                codes = letters(text)
                if len(codes) < min_chars or (cls := text_key(codes)) in seen:
                    continue
                if len(seen) < 1_000_000:  # only spares work, later steps don't rely on it
                    seen.add(cls)
                hashes = window_hashes(codes, width)
                if only is not None:
                    if only.start:
                        hashes = hashes[hashes >= np.uint64(only.start << (64 - bits))]
                    if only.stop < buckets:
                        hashes = hashes[hashes < np.uint64(only.stop << (64 - bits))]
                    if not len(hashes):
                        continue
                hashes = sorted_distinct(hashes)
                short = hashes >> np.uint64(32 - bits)
                places = (short >> np.uint64(32)).astype(np.int32)
                twice = np.concatenate([[False], short[1:] == short[:-1]])
                part = places >> coarse
                size, fell = np.bincount(part, minlength=PARTS), np.bincount(part, twice, PARTS).astype(int)
                short, places = short[~twice], places[~twice]
                cuts = np.flatnonzero(np.diff(places)) + 1
                parts = np.split(short.astype(np.uint32).view(np.int32), cuts)
                found = places[np.concatenate([[0], cuts])]
                at += found.tolist()
                classes += [cls] * len(parts)
                sizes += size[found >> coarse].tolist()
                lost += fell[found >> coarse].tolist()
                tokens += parts
            columns = [pa.array(x, t) for x, t in ((at, pa.int32()), (classes, pa.int64()), (sizes, pa.int32()), (lost, pa.int32()))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]) if tokens else np.zeros(1)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["bucket", "cls", "size", "lost", "tokens"])

    return texts.select("text").mapInArrow(run, "bucket int, cls long, size int, lost int, tokens array<int>")


def inverted_lists(sketched: DataFrame, buckets: int) -> DataFrame:
    """(token, part, weight, cls, size, lost): inverted lists with two members or more; equal ones of a part are one, with their number as weight.

    Where a bucket is a whole part, classes that share less than the threshold with all others have no partner and are left out.
    """
    coarse = (buckets // min(buckets, PARTS)).bit_length() - 1
    names, types = ["token", "part", "weight", "cls", "size", "lost"], [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    def close(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        cls, size, lost, counts = (np.concatenate([p[k] for p in parts]) for k in range(4))
        distinct, first, owner = np.unique(cls, return_index=True, return_inverse=True)
        size, lost = size[first], lost[first]
        packed = np.concatenate([p[4] for p in parts]).view(np.uint32).astype(np.uint64) << np.uint64(32)
        packed |= np.repeat(owner.astype(np.uint64), counts)
        packed.sort()
        keep = np.ones(len(packed), bool)
        keep[1:] = packed[1:] != packed[:-1]  # a class that came from two partitions
        if not keep.all():
            packed = packed[keep]
        for again in range(2):
            token = (packed >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            n = np.diff(np.append(starts, len(token)))
            at = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
            if again or coarse:
                break
            shared = np.bincount(at, np.repeat(n > 1, n), len(distinct))
            packed = packed[(shared + lost >= THRESHOLD * size)[at] & np.repeat(n > 1, n)]
            if not len(packed):
                return empty
        with np.errstate(over="ignore"):
            key = mix(np.add.reduceat(mix(distinct.view(np.uint64))[at], starts) + n.astype(np.uint64) + np.uint64(bucket >> coarse << 32))
        common = np.flatnonzero(n > 1)
        keys, which, weight = np.unique(key[common], return_index=True, return_counts=True)
        begin, many = starts[common[which]], n[common[which]]
        ends = np.cumsum(many)
        members = at[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(begin, many)]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[members], t)) for x, t in ((distinct, pa.int64()), (size, pa.int32()), (lost, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), bucket >> coarse), pa.int32()), pa.array(weight, pa.int64()), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        last = None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bucket[a] != last and parts:
                    yield close(int(last), parts)
                    parts = []
                last = bucket[a]
                some = batch.slice(a, b - a)
                lists = some.column("tokens")
                parts.append((*(some.column(c).to_numpy().copy() for c in ("cls", "size", "lost")), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().copy()))
        if parts:
            yield close(int(last), parts)

    sorted_rows = sketched.repartition("bucket").sortWithinPartitions("bucket")
    found = sorted_rows.mapInArrow(run, "token long, part int, weight long, cls array<long>, size array<int>, lost array<int>")
    if not coarse:
        return found
    return found.groupBy("token", "part").agg(F.sum("weight").alias("weight"), F.first("cls").alias("cls"), F.first("size").alias("size"), F.first("lost").alias("lost"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """A row for each prefix list of a class: (token, role, cls, size, lost, common, weights).

    rows: cls, size, lost, common (array of (df, token, weight)). role: bits 1, 2 as the larger or smaller text of a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for cls, size, lost, common in zip(*(batch.column(c).to_pylist() for c in ("cls", "size", "lost", "common")), strict=True):
                common.sort(key=lambda x: (x["df"], x["token"]))  # the rarest come first; tokens that nothing else has come before them
                tokens, weights = [x["token"] for x in common], [x["weight"] for x in common]
                own = size - lost
                place = own - sum(weights)
                keep = [own - (int(least_overlap(size, smaller)) - lost) for smaller in (False, True)]
                for token, weight in zip(tokens, weights, strict=True):
                    role = (place <= keep[0]) + 2 * (place <= keep[1])
                    if not role:
                        break
                    for column, x in zip(out, (token, role, cls, size, lost, tokens, weights), strict=True):
                        column.append(x)
                    place += weight
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["token", "role", "cls", "size", "lost", "common", "weights"])

    return rows.mapInArrow(run, "token long, role int, cls long, size int, lost int, common array<long>, weights array<long>")


def divide_skip(owner: np.ndarray, token: np.ndarray, weight: np.ndarray, size: np.ndarray, lost: np.ndarray, threshold: float = THRESHOLD, merged: int = MERGED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of texts whose overlap reaches the threshold, by T-occurrence search with every text as the query.

    Texts are numbered in the order of their sizes. owner and token give the text and the inverted list of each place, lists being
    numbered from 0; a list counts weight[token] times. lost is added to the overlap of a query.

    A query needs an overlap of T with a text of its size or more. Its longest lists that together weigh less than T are long, the
    others short. The short lists of many queries are merged in one sort of their places; what is on them as often as T less the
    weight of the long ones is then looked for in these by binary search, while it can still reach what the pair needs.
    """
    n = len(size)
    order = np.lexsort((owner, token))
    owner, token = owner[order].astype(np.int64), token[order].astype(np.int64)
    places = token * n + owner
    length = np.bincount(token, minlength=len(weight))
    by_text = np.lexsort((token, -length[token], owner))
    lists, texts = token[by_text], owner[by_text]
    starts = np.searchsorted(texts, np.arange(n + 1))
    w = weight[lists].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(w)])
    up_to = total[1:] - total[starts[texts]]
    need = np.maximum(1, least_overlap(size, True, threshold) - lost)
    long = up_to < need[texts]
    n_long, weight_long = np.bincount(texts, long, n).astype(np.int64), np.bincount(texts, w * long, n).astype(np.int64)
    last = np.searchsorted(size, np.floor(size / threshold + 1e-9), "right")  # larger texts can't be partners
    short = np.flatnonzero(~long)
    begin = by_text[short] + 1  # partners come after the query in each list
    end = np.searchsorted(places, lists[short] * n + last[texts[short]])
    count = np.maximum(0, end - begin)
    short, begin, count = short[count > 0], begin[count > 0], count[count > 0]
    found: list[np.ndarray] = []
    ends = np.cumsum(count)
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + merged, "right")))
        to = int(np.searchsorted(texts[short], texts[short[to - 1]], "right"))  # whole queries
        c = count[at:to]
        which = np.repeat(np.arange(at, to), c)
        place = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + begin[which]
        pair = texts[short[which]] * n + owner[place]
        order = np.argsort(pair, kind="stable")
        pair, each = pair[order], w[short[which]][order]
        at = to
        heads = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, x = pair[heads], np.add.reduceat(each, heads) if len(heads) else each
        i, j = pair // n, pair % n
        least = np.ceil(threshold * (size[i] + size[j]) / (1 + threshold) - 1e-9).astype(np.int64) - lost[i]
        rest = weight_long[i].copy()
        probe = starts[i] + n_long[i] - 1  # from the shortest of the long lists to the longest
        keep = x + rest >= least
        while len(i):
            done = probe < starts[i]
            found.append(np.stack([i[keep & done], j[keep & done]]))
            keep &= ~done
            i, j, x, rest, probe, least = (v[keep] for v in (i, j, x, rest, probe, least))
            if not len(i):
                break
            wanted = lists[probe] * n + j
            there = np.searchsorted(places, wanted)
            hit = places[np.minimum(there, len(places) - 1)] == wanted
            x = x + w[probe] * hit
            rest = rest - w[probe]
            probe = probe - 1
            keep = x + rest >= least
    both = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def meeting(token: int, rows: list[tuple], left: int, right: int) -> list[tuple[int, int]]:
    """Candidate pairs of one meeting, given only if the token is the first at which the two meet.

    rows: (cls, block, role, size, lost, common, weights); left, right: the blocks whose members are paired, equal in a meeting of
    one block.
    """
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    size, lost = (np.array([r[k] for r in rows]) for k in (3, 4))
    owner = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
    distinct, number = np.unique(np.concatenate([np.array(r[5], np.int64) for r in rows]), return_inverse=True)
    weight = np.zeros(len(distinct), np.int64)
    weight[number] = np.concatenate([np.array(r[6], np.int64) for r in rows])
    held = [set(r[5]) for r in rows]
    pairs = []
    for i, j in zip(*(x.tolist() for x in divide_skip(owner, number, weight, size, lost)), strict=True):
        blocks = (rows[i][1], rows[j][1])
        # each list of common tokens is in the order of the prefixes: the first token of both is where they meet first
        if rows[i][2] & 2 and rows[j][2] & 1 and blocks in ((left, right), (right, left)) and next(t for t in rows[i][5] if t in held[j]) == token:
            pairs.append((rows[i][0], rows[j][0]))
    return pairs


def part_pairs(cls: np.ndarray, size: np.ndarray, lost: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that reach the threshold in a part. cls, size, lost and counts: a row of the part each; tokens: those of all rows."""
    distinct, first, number = np.unique(cls, return_index=True, return_inverse=True)
    by_size = np.lexsort((distinct, size[first]))
    rank = np.empty(len(by_size), np.int64)
    rank[by_size] = np.arange(len(by_size))
    distinct, first = distinct[by_size], first[by_size]
    size, lost = size[first].astype(np.int64), lost[first].astype(np.int64)
    packed = tokens.view(np.uint32).astype(np.uint64) << np.uint64(32)
    packed |= np.repeat(rank[number].astype(np.uint64), counts)
    packed.sort()
    keep = np.ones(len(packed), bool)
    keep[1:] = packed[1:] != packed[:-1]  # a class that came from two partitions
    packed = packed[keep]
    while True:  # a class that shares less than the threshold with all others has no partner, and is none
        token = (packed >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, int)
        n = np.diff(np.append(starts, len(token)))
        owner = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        common = np.repeat(n > 1, n)
        shared = np.bincount(owner, common, len(distinct))
        keep = common & (shared + lost >= least_overlap(size, False))[owner]
        if keep.all():
            break
        packed = packed[keep]
    if not len(packed):
        return distinct[:0], distinct[:0]
    with np.errstate(over="ignore"):  # equal lists become one
        key = mix(np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), starts) + n.astype(np.uint64))
    _, which, weight = np.unique(key, return_index=True, return_counts=True)
    ends = np.cumsum(n[which])
    place = np.arange(ends[-1]) - np.repeat(ends - n[which], n[which]) + np.repeat(starts[which], n[which])
    i, j = divide_skip(owner[place], np.repeat(np.arange(len(which)), n[which]), weight, size, lost)
    return distinct[i], distinct[j]


def pairs_in_parts(sketched: DataFrame, first: int, n_parts: int) -> DataFrame:
    """(x, y): pairs of classes that reach the threshold in one of the parts from `first` on, each of which is one bucket and fits into a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        last = None

        def close() -> pa.RecordBatch:
            x, y = part_pairs(*(np.concatenate([p[k] for p in parts]) for k in range(5)))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bucket[a] != last and parts:
                    yield close()
                last = bucket[a]
                some = batch.slice(a, b - a)
                lists = some.column("tokens")
                parts.append((*(some.column(c).to_numpy().copy() for c in ("cls", "size", "lost")), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().copy()))
        if parts:
            yield close()

    return sketched.repartitionById(n_parts, F.col("bucket") - first).mapInArrow(run, "x long, y long")


def candidate_pairs(texts: DataFrame, buckets: int = 1, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(a, b): pairs of classes that reach the threshold in a part; buckets as in `sketches`. Each pass takes whole parts."""
    parts = min(buckets, PARTS)
    divided = buckets // parts
    each = -(-parts // (passes if divided == 1 else max(passes, PASSES_AT_LISTS)))
    found = []
    for k in range(0, parts, each):
        only = range(k * divided, min(parts, k + each) * divided)
        sketched, made = sketches(texts, buckets, only=only), []
        found.append(staged(pairs_in_parts(sketched, k, len(only)) if divided == 1 else pairs_at_lists(sketched, block, buckets, made), "part").toDF("x", "y"))
        for step in made:
            discard(step)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pairs_at_lists(sketched: DataFrame, block: int = BLOCK, buckets: int = 1, made: list[DataFrame] | None = None) -> DataFrame:
    """(a, b) as `candidate_pairs`, for parts of several buckets: texts meet at the lists of their prefixes.

    made: takes the tables written on the way, which can be discarded when the pairs are written.
    """
    lists = inverted_lists(sketched, buckets)
    postings = lists.select("token", "part", "weight", F.size("cls").alias("df"), F.explode(F.arrays_zip("cls", "size", "lost")).alias("m")).select("token", "part", "weight", "df", "m.*")
    common = postings.groupBy("part", "cls", "size", "lost").agg(F.sum("weight").alias("n"), F.collect_list(F.struct("df", "token", "weight")).alias("common"))
    # a text shares at least as much of its substrings with any partner
    prefix = staged(_prefixes(common.filter(F.col("n") + F.col("lost") >= F.lit(THRESHOLD) * F.col("size")).select("cls", "size", "lost", "common")), "prefix")
    # A meeting with more members than a block is split into blocks, and each two blocks meet in a task of their own.
    large = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = staged(large.select("token", F.ceil(F.col("n") / block).cast("int").alias("n_blocks")), "large")
    blocks = bounded_broadcast(large)
    if made is not None:
        made += [prefix, large]
    members = prefix.join(blocks, "token", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = members.select("token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "role", "cls", "size", "lost", "common", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        group: list[tuple] = []
        key = None

        def close() -> None:
            if len(group) > 1 and any(r[2] & 2 for r in group):
                unique = list({(r[0], r[1]): r for r in group}.values())
                pairs.extend(meeting(key[0], unique, *key[1:]))
            group.clear()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["x", "y"])
            pairs.clear()
            return done

        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("token", "left", "right")), strict=True))
            rest = list(zip(*(batch.column(n).to_pylist() for n in ("cls", "block", "role", "size", "lost", "common", "weights")), strict=True))
            for i, now in enumerate(keys):
                if key != now:
                    close()
                    key = now
                group.append(rest[i])
            if len(pairs) > 50_000:
                yield flush()
        close()
        yield flush()

    meetings = members.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
    found = meetings.mapInArrow(run, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def exact_similarity(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds the exact Jaccard similarity to pairs (a, b) of classes; texts has (cls, text), a row for each class in pairs."""
    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").repartition("a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, key in enumerate(a):
                if key != last:
                    last, shingles = key, sorted_distinct(window_hashes(letters(batch.column("text_a")[i].as_py()), width))
                other = sorted_distinct(window_hashes(letters(batch.column("text_b")[i].as_py()), width))
                union = np.concatenate([shingles, other])
                union.sort()
                x = int(np.count_nonzero(union[1:] == union[:-1]))
                out.append(x / max(1, len(union) - x))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def memberships(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, cls) of each text with at least `min_chars` letters and digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and len(text) >= min_chars and len(codes := letters(text)) >= min_chars:
                    ids.append(key)
                    classes.append(text_key(codes))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int64())], ["id", "cls"])

    return texts.mapInArrow(run, "id long, cls long")


def near_duplicate_classes(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls) of every text that is long enough, and links (a, b, similarity) between classes.

    texts has the columns id (long) and text. Null and short texts are in no class, repeated rows count once, exact copies share
    a class. Links hold every pair of classes at the threshold; copies aren't expanded into pairs.
    """
    texts = texts.select("id", "text")
    members = staged(memberships(texts), "classes")
    length = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = 1 << (length // BUCKET).bit_length()
    pairs = staged(candidate_pairs(texts, buckets), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = staged(members.join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id")), "wanted")
    small = bounded_broadcast(one, 1_000_000)  # 16 bytes a row
    chosen = staged(texts.join(small, "id").dropDuplicates(["cls"]).select("cls", "text"), "texts")
    links = staged(exact_similarity(pairs, chosen).filter(F.col("similarity") >= threshold), "links")
    return members.distinct(), links


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id_a, page_id_b) of pages whose contents share at least half of their substrings of 20 letters and digits."""
    pages = table(spark, sf_dir, "formatted_pages").select(F.col("page_id").alias("id"), F.col("content").alias("text"))
    members, links = near_duplicate_classes(pages)
    linked = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls")
    part = staged(members.join(linked.union(copies).distinct(), "cls", "left_semi"), "members")
    left, right = part.select(F.col("cls").alias("a"), F.col("id").alias("i")), part.select(F.col("cls").alias("b"), F.col("id").alias("j"))
    across = links.join(left, "a").join(right, "b").select("i", "j")
    within = left.join(right, F.col("a") == F.col("b")).filter("i < j").select("i", "j")
    return across.union(within).select(F.least("i", "j").alias("page_id_a"), F.greatest("i", "j").alias("page_id_b")).distinct()


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page with its class and the class's number of links to other classes."""
    pages = table(spark, sf_dir, "formatted_pages").select(F.col("page_id").alias("id"), F.col("content").alias("text"))
    members, links = near_duplicate_classes(pages)
    counts = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(counts, "cls", "left").select(F.col("id").alias("page_id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
