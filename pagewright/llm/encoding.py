"""Problem 1: text that was decoded with the wrong code page.

A swap of code pages is a substitution cipher: each symbol (a character, or the run of characters that one multi-byte letter was
read as) stands for a letter. Bigrams of the languages in the corpus give every reading of a line its likelihood.

1. Lines with surprising pairs are read with the known swaps. Expectation-maximisation over each source's lines learns how common each
   swap is in it, which decides the lines in doubt. Lines that stay surprising under their best reading are those of unknown swaps.
2. For each source and swap, a table of symbols and letters is learned by expectation-maximisation on the counts of symbol bigrams
   against the language bigrams. Known swaps start at their code pages; unknown ones start from the ranks of symbols and letters by
   frequency, for each script, and keep the table of the likeliest one if it gains more than it costs to state.
3. The tables are applied with translate(). A line is affected if its text by a learned table is likelier than the line, in its own or in
   lower case. Lines with replacement characters are affected, but what was lost can't be restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import site_of
from pagewright.llm.language import labelled_documents
from pagewright.storage import bounded_broadcast, staged, table

# Code pages that text is read with by mistake, and ones that it was really written in.
READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "iso8859_2", "cp1250", "iso8859_15"]
SINGLE = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "cp850", "cp437", "mac_roman", "cp1250", "cp1256", "cp1253", "cp874"]
MULTI = ["utf-8", "gbk", "shift_jis", "euc_jp", "big5", "euc_kr"]
#: Wide code pages that UTF-8 is read with by mistake.
WIDE_READ = ["gbk", "shift_jis", "big5"]
# Marks that text in any script may hold.
MARKS = "«»—–“”„…№"
#: Prior weight of a clean line, rounds of the mixture, rounds of the tables of known and of unknown swaps.
CLEAN, MIX_ROUNDS, TABLE_ROUNDS, CIPHER_ROUNDS = 0.98, 3, 15, 60
#: Letters that a symbol of a known swap may stand for beside its own: the ones that fit its neighbours best.
RIVALS = 6
#: Surprise left, in nats, under its best reading, from which on a line may be of an unknown swap; cost of a symbol that a table changes.
UNEXPLAINED, STATED = 30.0, 6.0
#: Gain in log-likelihood that a reading needs over the line as it is, before its source's mixture is counted.
NEED = 3.0
#: Surprise of a pair, in nats, from which on it counts, and the excess from which on a line's readings are tried.
USUAL, EXCESS = 6.0, 0.5
#: What a reading's gain is lowered by: any single-byte page can read any byte, UTF-8 and the East Asian ones can't.
PENALTY = {"utf-8": 0.0} | dict.fromkeys(MULTI[1:], 3.0) | dict.fromkeys(SINGLE, 6.0)
#: Sightings that a known swap counts as, when a table is learned.
KNOWN = 20.0
#: What the counts of all documents of a language, and of all records, weigh at most, in documents and records: the priors are set for
#: counts of that size, and a swap that is common in a large corpus is as rare in these counts as in those of a small one.
DOCUMENTS, RECORDS = 120, 1500
#: The gain from which on a line isn't counted as usual.
GARBLED = 15.0
#: Characters whose pairs are counted at a time.
COUNTED = 1_000_000
LOST, UNKNOWN, ANY_SOURCE = "lost", "unknown", "*"
_PAIR = re.compile("[^\\x00-\\x7f]{2}")


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    """A small number for each code point's script and case."""
    names: dict[tuple, int] = {}
    out = np.zeros(0x110000, np.int16)
    for i in range(0x30000):
        c = chr(i)
        cat = unicodedata.category(c)
        if cat[0] in "LM":
            name = unicodedata.name(c, "?").split(" ")[0]
            accent = i > 126 and name == "LATIN"
            key = (name, cat if cat[0] == "L" else "M", accent)
        elif i < 127:
            key = ("ascii", cat)
        elif 0x2010 <= i <= 0x2026 or 0x3000 <= i <= 0x3011 or i in (0xAB, 0xBB, 0xA1, 0xBF, 0xB7, 0x203A, 0xA9, 0xA0):
            key = ("mark", cat)
        else:
            key = ("odd", cat, i >> 5)
        out[i] = names.setdefault(key, len(names))
    return out


class Bigrams:
    """Language bigrams: log-probabilities of pairs, from counts of characters within their classes and of pairs."""

    def __init__(self, texts: list[str], counted: dict[tuple[str, str], float] | None = None) -> None:
        """texts: to be counted here; counted: pairs with their counts, digits being 0."""
        pairs: Counter = Counter(counted or {})
        for t in texts:
            t = "".join("0" if c.isdigit() else c for c in f"\n{t}\n")
            pairs.update(zip(t, t[1:], strict=False))
        chars = sorted({c for p in pairs for c in p})
        classes = _class_of()
        n_classes = int(classes.max()) + 1
        self.n = len(chars) + n_classes  # then a stand-in for the unknown characters of each class
        self.number = (len(chars) + classes).astype(np.int32)
        for i, c in enumerate(chars):
            self.number[ord(c)] = i
        for i in range(0x700):
            if unicodedata.category(chr(i)) == "Nd" and "0" in chars:
                self.number[i] = chars.index("0")
        self.chars = chars
        of = np.concatenate([classes[[ord(c) for c in chars]].astype(int), np.arange(n_classes)])
        count = np.zeros((self.n, self.n), np.float32)
        for (a, b), k in pairs.items():
            count[self.number[ord(a)], self.number[ord(b)]] = k
        by_class = np.zeros((n_classes, n_classes), np.float32)
        rows, columns = np.nonzero(count)
        np.add.at(by_class, (of[rows], of[columns]), count[rows, columns])
        total = count.sum()
        p_class = (by_class + 0.02) / (by_class + 0.02).sum(1, keepdims=True)
        single = count.sum(0) + 0.3
        in_class = np.bincount(of, single, n_classes)
        size = np.bincount(of, minlength=n_classes)
        share = single / in_class[of]
        share[len(chars):] = 0.3 / (in_class + 30 * (size < 3))  # an unknown character is one of many
        row = count.sum(1, keepdims=True)
        self.log = np.empty((self.n, self.n), np.float16)
        for k in range(0, self.n, 256):  # in parts, for the driver's memory
            back = p_class[of[k : k + 256]][:, of] * share[None, :].astype(np.float32)
            self.log[k : k + 256] = np.log((count[k : k + 256] + 8 * back) / (row[k : k + 256] + 8))
        self.total = float(total)

    def shared(self, spark: SparkSession):  # noqa: ANN201
        """The broadcast of these bigrams, one for an application, since each is a file on every machine."""
        held = self.__dict__.setdefault("_shared", {})
        if (app := spark.sparkContext.applicationId) not in held:
            held[app] = spark.sparkContext.broadcast(self)
        return held[app]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_shared"}

    def surprise(self, lines: list[str]) -> np.ndarray:
        """Nats by which each line's pairs with a character beyond ASCII are rarer than such pairs are in the languages."""
        parts = [np.frombuffer(f"\n{t}\n".encode("utf-32-le", "surrogatepass"), np.uint32) for t in lines]
        codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        of = np.repeat(np.arange(len(lines)), [len(p) for p in parts])
        beyond = codes > 126
        at = np.flatnonzero((beyond[1:] | beyond[:-1]) & (of[1:] == of[:-1]))
        n = self.number[codes]
        surprise = -self.log[n[at], n[at + 1]].astype(np.float32) - USUAL
        return np.bincount(of[at], np.maximum(surprise, 0), len(lines))

    def odd(self, lines: list[str]) -> np.ndarray:
        """Whether each line is surprising enough for its readings to be tried."""
        return self.surprise(lines) > EXCESS

    def score(self, text: str) -> float:
        """Log-likelihood of a line."""
        codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        n = self.number[codes]
        return float(self.log[n[:-1], n[1:]].astype(np.float32).sum())


@lru_cache(maxsize=32)
def _byte_of(read: str) -> dict[int, int]:
    """Byte of each character of a code page, for str.translate to Latin-1; bytes without a character stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(read))] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        out.setdefault(b, b)
    if read == "cp1252":  # and ISO 8859-1
        for b in range(128, 256):
            out.setdefault(b, b)
    for c in range(128, 256):
        out.setdefault(c, 0xFFFD)  # not in the page: can't be turned into bytes
    return out


@lru_cache(maxsize=32)
def _charset(read: str) -> frozenset[str]:
    return frozenset(chr(c) for c, b in _byte_of(read).items() if b < 256)


def to_bytes(text: str, read: str) -> bytes | None:
    try:
        return text.translate(_byte_of(read)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def reread(text: str, swap: str) -> str | None:
    """The text as another code page has it; swap: `read>written`, with steps joined by `+`. None if it can't be."""
    for step in swap.split("+"):
        read, written = step.split(">")
        try:
            raw = text.encode(read) if read in WIDE_READ else to_bytes(text, read)
            text = raw.decode(written) if raw is not None else None
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        if text is None:
            return None
    return text


@lru_cache(maxsize=1)
def _single_tables() -> dict[str, np.ndarray]:
    """For each swap of single-byte pages, the character that each one of the first plane turns to; 0xFFFF where it can't be."""
    out = {}
    for read in READ_AS:
        byte_of = np.full(0x10000, -1, np.int32)
        byte_of[:128] = np.arange(128)
        for c, b in _byte_of(read).items():
            if b < 256 and c < 0x10000:
                byte_of[c] = b
        for written in SINGLE:
            if written != read:
                char_of = np.full(257, 0xFFFF, np.int32)
                for b in range(256):
                    try:
                        char_of[b] = ord(bytes([b]).decode(written))
                    except UnicodeDecodeError:
                        pass
                out[f"{read}>{written}"] = char_of[byte_of]
    return out


def single_gains(lines: list[str], bigrams: Bigrams) -> list[list[tuple[str, float]]]:
    """(swap, gain) of single-byte swaps of each line; all lines at once, over the pairs with a character beyond ASCII."""
    parts = [np.frombuffer(f"\n{t}\n".encode("utf-32-le", "surrogatepass"), np.uint32) for t in lines]
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    of = np.repeat(np.arange(len(lines)), [len(p) for p in parts])
    low = np.minimum(codes, 0xFFFF)
    beyond = codes > 127
    at = np.flatnonzero((beyond[1:] | beyond[:-1]) & (of[1:] == of[:-1]))
    odd = np.flatnonzero(beyond)
    n = bigrams.number[codes]
    base = np.bincount(of[at], bigrams.log[n[at], n[at + 1]].astype(np.float32), len(lines))
    out: list[list[tuple[str, float]]] = [[] for _ in lines]
    for swap, chars in _single_tables().items():
        turned = chars[low]
        bad = np.bincount(of[odd], turned[odd] == 0xFFFF, len(lines)) > 0
        if bad.all():
            continue
        changed = np.bincount(of[odd], turned[odd] != codes[odd], len(lines)) > 0
        use = at[~bad[of[at]]]
        m = bigrams.number[turned]
        gain = np.bincount(of[use], bigrams.log[m[use], m[use + 1]].astype(np.float32), len(lines)) - base - PENALTY[swap.partition(">")[2]]
        for i in np.flatnonzero(~bad & changed & (gain > -NEED)).tolist():
            out[i].append((swap, float(gain[i])))
    return out


def multi_readings(line: str, bigrams: Bigrams) -> list[tuple[str, float]]:
    """(swap, gain) of swaps from multi-byte pages."""
    found = []
    base = None
    by_bytes = READ_AS if _PAIR.search(line) else []  # else no letter of two bytes or more, unless a wide page made one character of it
    chars = {c for c in set(line) if c > "\x7f"}
    for read in [*by_bytes, *WIDE_READ]:
        if read in WIDE_READ:
            try:
                raw, written_in = line.encode(read), MULTI[:1]
            except UnicodeEncodeError:
                continue
        else:
            raw, written_in = to_bytes(line, read) if chars <= _charset(read) else None, MULTI
        if raw is None:
            continue
        for written in written_in:
            try:
                text = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if text == line:
                continue
            if base is None:
                base = bigrams.score(line)
            gain = bigrams.score(text) - base - PENALTY[written]
            swap = f"{read}>{written}"
            if written == "utf-8":
                for more in ("cp1252>utf-8", "cp437>utf-8", "mac_roman>utf-8"):  # twice decoded
                    again = reread(text, more)
                    if again is not None and again != text and (second := bigrams.score(again) - base) > gain:
                        swap, gain = f"{swap}+{more}", second
            if gain > -NEED:
                found.append((swap, gain))
    return found


def readings_of(lines: list[str], bigrams: Bigrams) -> list[list[tuple[str, float]]]:
    """For each line, (swap, gain in log-likelihood) of the readings in doubt or better than the line as it is, the best first."""
    out: list[list[tuple[str, float]]] = [[(LOST, 20.0)] if "\ufffd" in t else [] for t in lines]
    rest = [i for i, t in enumerate(lines) if not out[i] and not t.isascii()]
    for i, single in zip(rest, single_gains([lines[i] for i in rest], bigrams), strict=True):
        out[i] = sorted(single + multi_readings(lines[i], bigrams), key=lambda x: (-x[1], x[0]))
    return out


def readings(line: str, bigrams: Bigrams) -> list[tuple[str, float]]:
    return readings_of([line], bigrams)[0]


def symbols(line: str, swap: str) -> list[tuple[str, str]]:
    """(symbol, letter) pairs of a line: what each letter of the reading was read as."""
    if swap == LOST:
        return []
    text = reread(line, swap)
    if text is None:
        return []
    steps = [s.split(">") for s in swap.split("+")]
    out = []
    for c in text:
        seen = c
        for read, written in reversed(steps):
            raw = seen.encode(written)
            seen = raw.decode(read, "replace") if read in WIDE_READ else "".join(_char_of(read)[b] for b in raw)
        out.append((seen, c))
    return out


@lru_cache(maxsize=32)
def _char_of(read: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def doubtful_lines(records: DataFrame, bigrams: Bigrams) -> DataFrame:
    """(field_name, page_id, source, line_no, line, swap, gain): every line with a reading in doubt, a row for each such reading.

    Lines that are surprising under their best reading have a row for an unknown swap besides. records: field_name, page_id, source,
    text.
    """
    shared = bigrams.shared(records.sparkSession)
    lines = records.select("field_name", "page_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(F.octet_length("line") > F.length("line"))  # others are ASCII only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Bigrams = shared.value
        for batch in batches:
            at, swaps, gains = [], [], []
            lines_of = batch.column("line").to_pylist()
            for start in range(0, len(lines_of), 2000):
                some = (start + np.flatnonzero(model.odd(lines_of[start : start + 2000]))).tolist()
                distinct = {lines_of[i]: None for i in some}  # a site's lines come again and again
                known = dict(zip(distinct, readings_of(list(distinct), model), strict=True))
                best = [reread(t, found[0][0]) if (found := known[t]) and found[0][0] != LOST and found[0][1] > 0 else t for t in distinct]
                for t, left in zip(distinct, model.surprise([x or "" for x in best]), strict=True):
                    if left >= UNEXPLAINED and "\ufffd" not in t:
                        known[t] = [*known[t], (UNKNOWN, 0.0)]
                for i in some:
                    for swap, gain in known[lines_of[i]]:
                        at.append(i)
                        swaps.append(swap)
                        gains.append(gain)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(swaps, pa.string()), pa.array(gains, pa.float64())], [*part.schema.names, "swap", "gain"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInArrow(run, f"{fields}, swap string, gain double")


def judged_lines(doubtful: DataFrame, rounds: int = MIX_ROUNDS) -> DataFrame:
    """Adds to each reading its posterior, by expectation-maximisation over how common each swap is in its source."""
    key = ["field_name", "page_id", "line_no", "line"]
    lines = doubtful.withColumn("source", F.coalesce("source", F.lit(""))).dropDuplicates([*key, "swap"])  # redelivered rows
    share = None
    for k in range(rounds + 1):
        if share is None:
            weighed = lines.withColumn("w", F.lit((1 - CLEAN) / 20))
        else:
            weighed = lines.join(share, ["source", "swap"], "left").withColumn("w", F.coalesce("share", F.lit(1e-6)))
        # the readings of a line are few, and lie together after one shuffle
        best = F.max("gain").over(_over(key))
        weighed = weighed.withColumn("l", F.col("w") * F.exp(F.col("gain") - best)).withColumn("clean", CLEAN * F.exp(-best))
        total = F.sum("l").over(_over(key))
        now = weighed.withColumn("posterior", F.col("l") / (total + F.col("clean"))).withColumn("any", total / (total + F.col("clean")))
        if k == rounds:
            return now.drop("w", "l", "clean", "share")
        counts = now.groupBy("source", "swap").agg(F.sum("posterior").alias("n"))
        by_source = counts.groupBy("source").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        # a swap's share of the source's garbled lines, with one pseudo-line for each swap
        share = counts.join(by_source, "source").select("source", "swap", ((F.col("n") + 0.02) * (1 - CLEAN) * 3 / (F.col("all") + 1)).alias("share"))
        share = bounded_broadcast(staged(share, "swaps"))
    raise AssertionError


def _over(key: list[str]):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*key)


def fit_table(pairs: dict[tuple[str, str], float], start: dict[str, str], bigrams: Bigrams, rounds: int = TABLE_ROUNDS, rivals: int = RIVALS) -> dict[str, str]:
    """Letter of each symbol of a known swap, by expectation-maximisation on counts of symbol bigrams against the language bigrams.

    start has the letters of the swap, which count as KNOWN sightings. A symbol beyond ASCII may instead stand for one of the table's letters
    that fit best between its neighbours' own; alphabets of any size are learned alike.
    """
    seen = sorted({s for p in pairs for s in p})
    if not seen:
        return {}
    letters = sorted({start.get(s, s) for s in seen})
    letter_at, where = {c: i for i, c in enumerate(letters)}, {s: i for i, s in enumerate(seen)}
    own = np.array([letter_at[start.get(s, s)] for s in seen])
    numbers = bigrams.number[[ord(c[0]) for c in letters]]
    log = bigrams.log[np.ix_(numbers, numbers)].astype(np.float32)
    a, b = (np.array([where[p[k]] for p in pairs]) for k in (0, 1))
    n = np.array(list(pairs.values()))
    fits = np.zeros((len(seen), len(letters)), np.float32)
    for k in range(0, len(n), 2000):  # in parts, for the worker's memory
        part = slice(k, k + 2000)
        np.add.at(fits, a[part], n[part, None] * log[:, own[b[part]]].T)
        np.add.at(fits, b[part], n[part, None] * log[own[a[part]]])
    plain = np.array([c.isascii() for c in letters])
    fits[:, plain] = -np.inf  # a swap of code pages leaves ASCII as it is
    fits[np.arange(len(seen)), own] = np.inf
    fits[np.array([s.isascii() for s in seen])] = -np.inf
    fits[np.arange(len(seen)), own] = np.inf
    k = min(rivals + 1, len(letters))
    held = np.argsort(-fits, axis=1, kind="stable")[:, :k]  # the own letter first
    possible = np.isfinite(np.take_along_axis(fits, held, 1)) | (held == own[:, None])
    prior = np.where(possible, 0.02 / k, 0)
    prior[:, 0] += 0.98
    t = prior.copy()
    for _ in range(rounds):
        joint = t[a][:, :, None] * np.exp(log[held[a][:, :, None], held[b][:, None, :]]) * t[b][:, None, :]
        joint *= (n / np.maximum(joint.sum((1, 2)), 1e-300))[:, None, None]
        t = KNOWN * prior
        np.add.at(t, a, joint.sum(2))
        np.add.at(t, b, joint.sum(1))
        sightings = t
        t = t / np.maximum(np.bincount(held.ravel(), t.ravel(), len(letters)), 1e-300)[held]
    return {s: letters[held[i, sightings[i].argmax()]] for s, i in where.items()}


def alphabets(bigrams: Bigrams) -> dict[str, list[str]]:
    """Letters beyond ASCII of each script that the bigrams know and that a single-byte page can hold."""
    found: dict[str, list[str]] = {}
    for c in bigrams.chars:
        if ord(c) > 127 and unicodedata.category(c)[0] in "LM":
            found.setdefault(unicodedata.name(c, "?").split(" ")[0], []).append(c)
    return {script: letters for script, letters in found.items() if len(letters) <= 128}


def fit_cipher(pairs: dict[tuple[str, str], float], bigrams: Bigrams, rounds: int = CIPHER_ROUNDS) -> dict[str, str]:
    """Letters of the symbols of an unknown single-byte swap, empty if none explains the pairs for less than it costs to state.

    Every script is tried. The table starts from how near symbol and letter are in rank by frequency, a symbol that is itself a letter of the
    script being its likeliest reading, and is fitted by expectation-maximisation: the pair (x, y) of letters has the language's
    probability, and each letter is seen as a symbol with the table's.
    """
    seen = sorted({s for p in pairs for s in p})
    plain, odd = [c for c in seen if c.isascii()], [c for c in seen if not c.isascii()]
    if not odd:
        return {}
    symbols_ = plain + odd
    at = {c: i for i, c in enumerate(symbols_)}
    n = np.zeros((len(symbols_), len(symbols_)))
    for (x, y), k in pairs.items():
        n[at[x], at[y]] += k
    rank_of = lambda x: np.argsort(np.argsort(-x, kind="stable"), kind="stable")
    marks = [c for c in MARKS if c in bigrams.chars]
    k0, best, best_likelihood = len(plain), {}, -np.inf
    for script in sorted(letters_of := alphabets(bigrams)):
        letters = plain + letters_of[script] + marks
        ids = bigrams.number[[ord(c) for c in letters]]
        given = np.exp(bigrams.log[np.ix_(ids, ids)].astype(float))
        step = given / given.sum(1, keepdims=True)
        share = np.full(len(letters), 1 / len(letters))
        for _ in range(200):
            share = share @ step
        p = share[:, None] * given
        p /= p.sum()
        t = np.zeros((len(symbols_), len(letters)))
        t[:k0, :k0] = np.eye(k0)
        t[k0:, k0:] = np.exp(-np.abs(rank_of(n.sum(1)[k0:])[:, None] - rank_of(share[k0:])[None, :]) / 4) + 0.02
        for i, c in enumerate(odd):
            if c in letters:
                t[k0 + i, letters.index(c)] += 1
        t /= np.maximum(t.sum(0, keepdims=True), 1e-300)
        for _ in range(rounds):
            w = n / np.maximum(t @ p @ t.T, 1e-300)
            t = t * (w @ t @ p.T + w.T @ t @ p) + 1e-9 * (t > 0)
            t[:k0, :k0] = np.eye(k0) * max(1.0, t[k0:].sum())  # a swap of code pages leaves ASCII as it is
            t /= np.maximum(t.sum(0, keepdims=True), 1e-300)
        likelihood = float((n * np.log(np.maximum(t @ p @ t.T, 1e-300))).sum())
        if likelihood > best_likelihood:
            best_likelihood = likelihood
            best = {c: letters[int((t[k0 + i] * share).argmax())] for i, c in enumerate(odd)}
    changed = {c: x for c, x in best.items() if c != x}
    gain = sum(k * (_log(bigrams, best.get(x, x), best.get(y, y)) - max(_log(bigrams, x, y), _log(bigrams, x.lower(), y.lower()))) for (x, y), k in pairs.items())
    return best if changed and gain > STATED * len(changed) else {}


def _log(bigrams: Bigrams, x: str, y: str) -> float:
    return float(bigrams.log[bigrams.number[ord(x[0])], bigrams.number[ord(y[0])]])


def symbol_tables(judged: DataFrame, bigrams: Bigrams) -> DataFrame:
    """(source, swap, symbol, letter): the tables learned from the lines that are most likely garbled.

    judged: source, swap, line, posterior; lines of unknown swaps are taken once for each source, and once for the table of all sources.
    """
    shared = bigrams.shared(judged.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for source, swap, line in zip(*(batch.column(c).to_pylist() for c in ("source", "swap", "line")), strict=True):
                found = [("\n", "\n"), *(((c, c) for c in _one_digit(line)) if swap == UNKNOWN else symbols(line, swap)), ("\n", "\n")]
                counts.update((source, swap, x, y, u, v) for (x, u), (y, v) in zip(found, found[1:], strict=False))
            columns = list(zip(*counts, strict=True)) if counts else [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(counts.values()), pa.float64())], ["source", "swap", "a", "b", "u", "v", "n"])

    known = judged.filter((F.col("posterior") > 0.5) & ~F.col("swap").isin(LOST, UNKNOWN)).select("source", "swap", "line")
    unknown = judged.filter(F.col("swap") == UNKNOWN).select(F.explode(F.array("source", F.lit(ANY_SOURCE))).alias("source"), "swap", "line").distinct()
    counted = known.unionByName(unknown).mapInArrow(pairs, "source string, swap string, a string, b string, u string, v string, n double")
    counted = counted.groupBy("source", "swap", "a", "b", "u", "v").agg(F.sum("n").alias("n"))

    def fit(g: pa.Table) -> pa.Table:
        start: dict[str, str] = {}
        n: dict[tuple[str, str], float] = {}
        for a, b, u, v, k in zip(*(g.column(c).to_pylist() for c in ("a", "b", "u", "v", "n")), strict=True):
            start.setdefault(a, u)
            start.setdefault(b, v)
            n[(a, b)] = n.get((a, b), 0.0) + k
        source, swap = g.column("source")[0].as_py(), g.column("swap")[0].as_py()
        found = fit_cipher(n, shared.value) if swap == UNKNOWN else fit_table(n, start, shared.value)
        rows = [[source] * len(found), [swap] * len(found), list(found), list(found.values())]
        return pa.Table.from_arrays([pa.array(x, pa.string()) for x in rows], ["source", "swap", "symbol", "letter"])

    # a group is an alphabet's bigrams, whatever the number of lines
    return counted.groupBy("source", "swap").applyInArrow(fit, "source string, swap string, symbol string, letter string")


def _one_digit(line: str) -> str:
    return "".join("0" if c.isdigit() else c for c in line)


def deciphered(line: str, swap: str, table_: dict[str, str]) -> str:
    """The line by a learned table."""
    if swap == UNKNOWN:
        return line.translate({ord(s): c for s, c in table_.items()})
    marks, letters, plain = {}, {}, []
    for symbol, letter in symbols(line, swap):  # each symbol becomes one private character, which translate() replaces
        mark = marks.setdefault(symbol, chr(0xF0000 + len(marks)))
        letters[ord(mark)] = table_.get(symbol, letter)
        plain.append(mark)
    return "".join(plain).translate(letters)


def restored_lines(judged: DataFrame, tables: DataFrame, bigrams: Bigrams) -> DataFrame:
    """(field_name, page_id, line_no, line, swap, gain, restored) of every affected line; restored is null where text was lost.

    judged: as from `judged_lines`, with the rows of unknown swaps; tables: as from `symbol_tables`. Of a line's tables, the one that gains most
    in log-likelihood is taken; a line is affected if it gains at least NEED beyond what its kind of swap is lowered by.
    """
    shared = bigrams.shared(judged.sparkSession)
    by = tables.groupBy("source", "swap").agg(F.collect_list(F.struct("symbol", "letter")).alias("letters"))
    by = bounded_broadcast(by, sized_by=tables)
    likely = judged.filter(((F.col("posterior") > 0.5) | (F.col("swap") == UNKNOWN))).select("field_name", "page_id", "source", "line_no", "line", "swap")
    # every line is tried with its own swap's table, and with those of unknown swaps of its source and of all sources
    unknown = F.lit(UNKNOWN)
    tried = F.array(F.struct("source", "swap"), F.struct("source", unknown.alias("swap")), F.struct(F.lit(ANY_SOURCE).alias("source"), unknown.alias("swap")))
    either = likely.filter(F.col("swap") != LOST).select("field_name", "page_id", "line_no", "line", F.inline(F.array_distinct(tried))).unionByName(likely.filter(F.col("swap") == LOST).drop("source").withColumn("source", F.lit(ANY_SOURCE)))
    joined = either.join(by, ["source", "swap"], "left").filter((F.col("swap") != UNKNOWN) | F.col("letters").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Bigrams = shared.value
        for batch in batches:
            gains, texts = [], []
            for line, swap, letters in zip(*(batch.column(c).to_pylist() for c in ("line", "swap", "letters")), strict=True):
                text, gain = None, 20.0
                if swap != LOST:
                    text = deciphered(line, swap, {x["symbol"]: x["letter"] for x in letters or ()})
                    # correctly written capitals are rarer than small letters, but no swap
                    base = model.score(line) if swap != UNKNOWN else max(model.score(line), model.score(line.lower()))
                    gain = model.score(text) - base - PENALTY.get(swap.partition("+")[0].partition(">")[2], STATED)
                gains.append(gain)
                texts.append(text)
            part = batch.select(["field_name", "page_id", "line_no", "line", "swap"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(gains, pa.float64()), pa.array(texts, pa.string())], [*part.schema.names, "gain", "restored"])

    types = dict(judged.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in ("field_name", "page_id", "line_no", "line", "swap"))
    read = joined.select("field_name", "page_id", "line_no", "line", "swap", "letters").mapInArrow(run, f"{fields}, gain double, restored string").filter(F.col("gain") >= F.when(F.col("swap") == UNKNOWN, 3 * NEED).otherwise(-NEED))
    best = F.row_number().over(_over(["field_name", "page_id", "line_no"]).orderBy(F.desc("gain"), "swap"))
    return read.withColumn("_rank", best).filter("_rank = 1").drop("_rank")


def affected_lines(records: DataFrame, bigrams: Bigrams) -> DataFrame:
    """(field_name, page_id, line_no, line, swap, gain, restored) of every affected line of records (field_name, page_id, source, text).

    Null and empty texts have no lines; repeated rows count once; a null source is one of its own.
    """
    doubtful = staged(doubtful_lines(records.select("field_name", "page_id", "source", "text"), bigrams), "doubtful")
    known = judged_lines(doubtful.filter(F.col("swap") != UNKNOWN))
    unknown = doubtful.filter(F.col("swap") == UNKNOWN).withColumn("source", F.coalesce("source", F.lit(""))).dropDuplicates(["field_name", "page_id", "line_no", "line"])
    columns = ["field_name", "page_id", "source", "line_no", "line", "swap", "posterior"]
    # the likeliest known swap of each line that is likelier garbled than not
    first = F.row_number().over(_over(["field_name", "page_id", "line_no"]).orderBy(F.desc("posterior"), "swap"))
    known = known.withColumn("_rank", first).filter((F.col("_rank") == 1) & (F.col("any") > 0.5)).withColumn("posterior", F.lit(1.0))
    judged = staged(known.select(*columns).unionByName(unknown.withColumn("posterior", F.lit(0.0)).select(*columns)), "judged")
    return restored_lines(judged, staged(symbol_tables(judged, bigrams), "letters"), bigrams)


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fields as (field_name, page_id, source, text)."""
    shots = table(spark, sf_dir, "snapshots").select(F.lit("snapshots.text").alias("field_name"), "page_id", site_of(F.col("url")).alias("source"), "text")
    pages = table(spark, sf_dir, "formatted_pages").select(F.lit("formatted_pages.title").alias("field_name"), "page_id", site_of(F.col("url")).alias("source"), F.col("title").alias("text"))
    return shots.unionByName(pages).filter("text is not null")


@lru_cache(maxsize=1)
def _plain_digits() -> np.ndarray:
    """Each code point, 0 for digits."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[i for i in range(0x110000) if chr(i).isdigit()]] = ord("0")
    return out


def pair_counts(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, n): code points of the pairs of characters in lines, with the line breaks around them, digits being 0."""
    keys, counts = [], []
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) < COUNTED):
            size += len(lines[end]) + 1
            end += 1
        text = "\n".join(["", *lines[at:end], ""])
        codes = _plain_digits()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        a, b = codes[:-1], codes[1:]
        plain = (a | b) < 128
        few = np.bincount(a[plain] * np.uint32(128) + b[plain], minlength=1 << 14)
        some = np.flatnonzero(few)
        rest, n = np.unique(a[~plain].astype(np.int64) << 21 | b[~plain], return_counts=True)
        keys += [some >> 7 << 21 | some & 127, rest]
        counts += [few[some], n]
        at = end
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> 21, key & 0x1FFFFF, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def counted_pairs(texts: DataFrame, first: Bigrams | None = None) -> DataFrame:
    """(label, first, second, n): pairs of characters in all texts (label, text), counted by label.

    first: lines that are garbled by these bigrams aren't counted.
    """
    shared = first.shared(texts.sparkSession) if first else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(label, []).extend(text.split("\n"))
            for label, lines in by.items():
                if shared:
                    garbled = _garbled(lines, shared.value)
                    lines = [x for x in lines if x not in garbled] if garbled else lines
                columns = pair_counts(lines)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["label", "first", "second", "n"])

    found = texts.select("label", "text").filter("text is not null").mapInArrow(run, "label string, first long, second long, n long")
    return found.groupBy("label", "first", "second").agg(F.sum("n").alias("n"))


def _garbled(lines: list[str], bigrams: Bigrams) -> set[str]:
    """The lines that a reading gains more than GARBLED for."""
    out: set[str] = set()
    distinct = list({x: None for x in lines if not x.isascii()})  # a site's lines come again and again
    for k in range(0, len(distinct), 2000):
        part = distinct[k : k + 2000]
        doubt = [x for x, o in zip(part, bigrams.odd(part), strict=True) if o]
        out |= {x for x, found in zip(doubt, readings_of(doubt, bigrams), strict=True) if any(g > GARBLED for _, g in found)}
    return out


def weighed_pairs(counted: DataFrame, sizes: DataFrame, most: int) -> dict[tuple[str, str], float]:
    """Sums of the counts over all labels, each weighed as that of at most `most` texts. sizes: (label, size), a row for each label.

    A pair has one row, whatever the number of texts: there are as many as the alphabets have.
    """
    weight = F.least(F.lit(1.0), F.lit(float(most)) / F.col("size"))
    rows = counted.join(F.broadcast(sizes), "label").groupBy("first", "second").agg(F.sum(F.col("n") * weight).alias("n")).toArrow()
    columns = (rows.column(c).to_pylist() for c in ("first", "second", "n"))
    return {(chr(a), chr(b)): n for a, b, n in sorted(zip(*columns, strict=True))}


def fit_bigrams(spark: SparkSession, sf_dir: str) -> Bigrams:
    """Bigrams of all labelled documents, and of all records' lines that aren't garbled by those of the documents."""
    documents = labelled_documents(spark, sf_dir).select("label", "text").filter("text is not null")
    sizes = documents.groupBy("label").agg(F.count(F.lit(1)).alias("size"))  # a row for each listed language
    pairs = weighed_pairs(counted_pairs(documents), sizes, DOCUMENTS)
    records = corpus_records(spark, sf_dir).select(F.lit("").alias("label"), "text")
    usual = weighed_pairs(counted_pairs(records, Bigrams([], pairs)), records.groupBy("label").agg(F.count(F.lit(1)).alias("size")), RECORDS)
    for pair, n in usual.items():
        pairs[pair] = pairs.get(pair, 0.0) + n
    return Bigrams([], pairs)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, page_id) of every value that was, in whole or in some lines, decoded with a wrong encoding."""
    return affected_lines(corpus_records(spark, sf_dir), fit_bigrams(spark, sf_dir)).select("field_name", "page_id").distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected line with the text restored by its source's table, null where text was lost."""
    return affected_lines(corpus_records(spark, sf_dir), fit_bigrams(spark, sf_dir)).distinct()


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
