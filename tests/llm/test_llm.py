"""The operators for training text: small cases against brute force, round trips, and the rows that tables really hold."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import encoding, language, main_body, mixing, near_duplicates, packing, residue, sentences, site_lines
from pagewright.llm.near_duplicates import least_overlap, near_duplicate_classes
from pagewright.llm.shingles import letters, window_hashes
from pagewright.llm.tokens import joined, words

PAGE = "page_id long, url string, content string, site string, line_no string, n long"


def pages(spark, rows):  # noqa: ANN001, ANN201
    """Pages with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], PAGE)


# sentences

SENTENCES = [
    ('"Stop!" they wrote. Next one.', ['"Stop!" they wrote.', "Next one."]), ("Mr. A. B. Solpra paid $3.5 e.g. in main.js. Then No. 5 came.", ["Mr. A. B. Solpra paid $3.5 e.g. in main.js.", "Then No. 5 came."]), ("At 9:58 a.m. the ship left ... but only once. Why? Yes!", ["At 9:58 a.m. the ship left ... but only once.", "Why?", "Yes!"]),
    ("# Head\n\n- item one\n- item two", ["# Head", "- item one", "- item two"]), ("Laut Dr. X z. B. am 1. März. Und d. h. so. „Ja!“, rief er. Er sagte: „Nein.“ Gut.", ["Laut Dr. X z. B. am 1. März.", "Und d. h. so.", "„Ja!“, rief er.", "Er sagte: „Nein.“", "Gut."]),
    ("« Oui ! » s’écrie A. Il dit : « Non. » Puis.", ["« Oui ! » s’écrie A. Il dit : « Non. »", "Puis."]), ("「はい。いいえ。」と言った。次の文！", ["「はい。いいえ。」と言った。", "次の文！"]), ("“好！”他说道。他回答：“不。”走了3.5米。", ["“好！”他说道。", "他回答：“不。”", "走了3.5米。"]),
    ("वह गया। “आओ!” उसने कहा। डॉ. देमे आए।", ["वह गया।", "“आओ!” उसने कहा।", "डॉ. देमे आए।"]), ("قال د. سالا نعم. «تعال!» كتب ميني. هل هذا صحيح؟ نعم.", ["قال د. سالا نعم.", "«تعال!» كتب ميني.", "هل هذا صحيح؟", "نعم."]), ("สะพาน 42.9 ครั้ง ตลาด เปิด", ["สะพาน 42.9 ครั้ง", "ตลาด", "เปิด"]),
    ("", []), ("  \n \t\n", []), ("no end", ["no end"]), ("A.\r\nB.", ["A.", "B."]), ("xy. Z", ["xy.", "Z"]),
]


def test_sentences(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in enumerate(SENTENCES)] + [(99, None, 1, 2)], "doc_id long, text string, end_pos int, unit int")
    rows = sentences.split_sentences(df).orderBy("doc_id", "unit").collect()
    by = {i: [r["sentence"] for r in rows if r["doc_id"] == i] for i in range(100)}
    for i, (text, expected) in enumerate(SENTENCES):
        if i != 5:  # an initial before "Il" reads as a name
            assert by[i] == expected, text
    assert by[99] == []
    for r in rows:  # positions hold in the original
        assert SENTENCES[r["doc_id"]][0][: r["end_pos"]].endswith(r["sentence"])
    long = spark.createDataFrame([(1, "A sentence ends. " * 20_000)], "doc_id long, text string")
    assert sentences.split_sentences(long).count() == 20_000
    assert sentences.split_sentences(df.limit(0)).count() == 0


# repeated lines


def test_site_lines_against_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(1)
    rows = []
    for p in range(60):
        site = ["https://www.a.example/x", "HTTP://B.example:80/y"][p % 2]
        lines = [f"Unique line number {rng.random()} of a page", "Terms  of use 2021" if rng.random() < 0.5 else "terms of use 1999", "Rare words here only" if p < 8 else "", "ab"]
        rows.append((p, site, "\n".join(lines)))
    rows += [rows[0], (100, None, "Terms of use 2021"), (101, "https://a.example", None), (102, "https://a.example", ""), (103, "https://a.example", "Terms of use 5 " * 30_000)]
    got = {tuple(r) for r in site_lines.repeated_lines(pages(spark, rows)).collect()}
    expected = set()
    norm = lambda x: __import__("re").sub(r"\d+", "0", " ".join(x.lower().split()))
    for site in ("a.example", "b.example"):
        own = {r for r in rows if r[1] and site in r[1].lower()}
        lines = [(p, i, norm(x)) for p, _, c in own for i, x in enumerate((c or "").split("\n")) if sum(map(str.isalpha, x)) >= 10]
        n = len({r[0] for r in own})
        for p, i, x in lines:
            k = len({q for q, _, y in lines if y == x})
            if k >= 10 and k >= 0.15 * n:
                expected.add((p, i))
    assert got == expected and got
    cleaned = {r["page_id"]: r["content"] for r in site_lines.without_repeated_lines(pages(spark, rows)).collect()}
    assert "erms" not in cleaned[0] and cleaned[101] is None and cleaned[102] == "" and cleaned[100] == "Terms of use 2021"
    assert site_lines.repeated_lines(pages(spark, rows).limit(0)).count() == 0


# near-duplicates


def brute_pairs(texts: dict[int, str]) -> set[tuple[int, int]]:
    sets = {k: set(window_hashes(letters(t)).tolist()) for k, t in texts.items() if t and len(letters(t)) >= 300}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def near_texts() -> dict[int, str]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(600)]
    texts, k = {}, 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(70, 500))
        for _ in range(rng.choice([1, 1, 3])):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            cut = rng.randrange(len(edited))
            texts[k] = " ".join(edited[cut:] + edited[:cut]) + " shared footer of one and the same site " * 2
            k += 1
    texts[500], texts[501], texts[502], texts[503] = texts[0], texts[0].upper() + " !!", "short", texts[1] * 60
    return texts


def test_near_duplicates_against_brute_force(spark) -> None:  # noqa: ANN001
    texts = near_texts()
    rows = [(k, t, 1, 2) for k, t in texts.items()] + [(500, texts[500], 1, 2), (900, None, 1, 2), (901, "", 1, 2)]
    df = spark.createDataFrame(rows, "id long, text string, cls int, tokens int")
    members, links = near_duplicate_classes(df)
    of = {r["id"]: r["cls"] for r in members.collect()}
    got = {(min(a, b), max(a, b)) for x, y in ((r["a"], r["b"]) for r in links.collect()) for a in of for b in of if of[a] == x and of[b] == y}
    got |= {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert got == brute_pairs(texts)
    assert len(got) > 20 and 502 not in of and 900 not in of
    empty, none = near_duplicate_classes(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_parts_and_meetings_agree(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(list(near_texts().items()), "id long, text string")
    whole = {tuple(r) for r in near_duplicates.candidate_pairs(df).collect()}
    parts = {tuple(r) for r in near_duplicates.candidate_pairs(df, 8, passes=3).collect()}
    sketched = near_duplicates.sketches(df).cache()
    met = {tuple(r) for r in near_duplicates.pairs_at_lists(sketched).collect()}
    blocks = {tuple(r) for r in near_duplicates.pairs_at_lists(sketched, block=2).collect()}
    assert whole == met == blocks and whole and whole <= parts


def test_divided_parts_are_searched_in_passes(spark, monkeypatch) -> None:  # noqa: ANN001
    """Where parts are divided into buckets, a pass takes some whole parts only, and what it wrote on the way is deleted."""
    from pagewright.storage import shared_folder

    monkeypatch.setattr(near_duplicates, "PARTS", 4)
    df = spark.createDataFrame(list(near_texts().items()), "id long, text string")
    taken, sketches = [], near_duplicates.sketches
    monkeypatch.setattr(near_duplicates, "sketches", lambda *args, only=None, **more: taken.append(only) or sketches(*args, only=only, **more))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {*folder.glob("prefix-*"), *folder.glob("large-*")}
    divided = {tuple(r) for r in near_duplicates.candidate_pairs(df, 16).collect()}
    assert taken == [range(0, 4), range(4, 8), range(8, 12), range(12, 16)]
    assert {*folder.glob("prefix-*"), *folder.glob("large-*")} == before
    assert divided == {tuple(r) for r in near_duplicates.candidate_pairs(df, 4).collect()} and divided


@pytest.mark.parametrize(("bucket", "parts"), [(10_000_000, 16), (1000, 16), (500, 2)])
def test_no_link_is_lost(spark, monkeypatch, bucket: int, parts: int) -> None:  # noqa: ANN001
    """Pairs just above the threshold, whose samples of substrings have little in common."""
    monkeypatch.setattr(near_duplicates, "BUCKET", bucket, raising=False)
    monkeypatch.setattr(near_duplicates, "PARTS", parts, raising=False)
    texts = {}
    for seed in (4275, 8664, 29360):
        rng = random.Random(seed)
        common, *ends = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (560, 260, 260))
        texts |= {2 * seed: common + ends[0], 2 * seed + 1: common + ends[1]}
    members, links = near_duplicate_classes(spark.createDataFrame(list(texts.items()), "id long, text string"))
    of = {r["cls"]: r["id"] for r in members.collect()}
    assert {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in links.collect()} == brute_pairs(texts) == {(2 * s, 2 * s + 1) for s in (4275, 8664, 29360)}


def test_divide_skip_against_counting() -> None:
    rng = np.random.default_rng(5)
    for merged in (4_000_000, 10):
        for _ in range(40):
            n, m = int(rng.integers(2, 40)), int(rng.integers(1, 60))
            weight = rng.integers(1, 4, m)
            base = rng.random((int(rng.integers(1, 5)), m)) < rng.random()
            held = base[rng.integers(0, len(base), n)] ^ (rng.random((n, m)) < 0.1)
            own = rng.integers(0, 5, n)  # substrings that nothing else has
            order = np.argsort(held @ weight + own, kind="stable")
            held, size = held[order], (held @ weight + own)[order]
            owner, token = np.nonzero(held)
            got = set(zip(*(x.tolist() for x in near_duplicates.divide_skip(owner, token, weight, size, np.zeros(n, int), merged=merged)), strict=True))
            x = (held * weight) @ held.T
            assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if x[i, j] and x[i, j] >= 0.5 * (size[i] + size[j] - x[i, j])}


def test_least_overlap_is_a_bound() -> None:
    for size in (20, 50, 90):
        for x in range(size):
            if near_duplicates.enough(np.array([x]), np.array([size]), np.array([size]))[0]:
                assert x >= least_overlap(np.array([size]), True)[0]


# tokens, residue


def test_words() -> None:
    codes, first = joined(["Ab c12 {{x}} 你好", "", "Ab"])
    begins, ends, hashes, _ = words(codes)
    found = ["".join(map(chr, codes[a:b])) for a, b in zip(begins, ends, strict=True)]
    assert found == ["ab", "c", "12", "{", "{", "x", "}", "}", "你", "好", "ab"]
    assert hashes[0] == hashes[-1] and len(first) == 3


def test_residue(spark, data) -> None:  # noqa: ANN001
    article = "The old bridge keeps its narrow path along the river. " * 30
    quoting = [article + f"Placeholders like ${{city}} are filled by the mail server of {x} before sending." for x in ("Gan", "Tol", "Vin")]
    filler = [article + f"Lorem ipsum dolor {w} sit amet porta augue purus ligula metus risus." for w in ("vel", "quis", "arcu", "diam")]
    marks = [article.replace("narrow", m) for m in ("{{ name }}", "%title%", "${city}", "[INSERT PRICE HERE]", "<%= author %>")]
    messages = ["Please enable JavaScript to view this page.", "404 Not Found\nThe page /x could not be found on this server.", "Access denied\nYou do not have permission to open /y."] * 3
    weights = residue.fit([article] * 6 + quoting * 3 + filler + marks + messages, [200] * (6 + 9 + 4 + 5) + [404] * 9, rounds=150)
    rows = [(1, article), (2, quoting[0]), (3, filler[0]), (4, marks[0]), (5, messages[0]), (6, None), (7, ""), (8, " \n"), (5, messages[0]), (9, article * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, text string, letters int")
    assert sorted(r["page_id"] for r in residue.residue(df, "page_id", "text", weights).collect()) == [3, 4, 5]
    assert residue.residue(df.limit(0), "page_id", "text", weights).count() == 0


def test_validation_counts_all_records(spark, monkeypatch, tmp_path) -> None:  # noqa: ANN001
    """Every labelled segment of the hosts kept for validation, whatever the size of the training sample."""
    monkeypatch.setattr(residue, "SAMPLE", 20)
    monkeypatch.setattr(residue, "LOOKED_AT", 100)
    rows = [(i, f"https://h{i % 40}.example/a", f"The canal number {i} keeps its narrow path for most of the year. " * 10, 200, "The canal") for i in range(400)]
    shots = spark.createDataFrame([*rows, rows[0], (900, "https://h1.example/a", None, 200, None)], "page_id long, url string, text string, status int, title string")
    shots.write.parquet(str(tmp_path / "snapshots.parquet"))
    shots.limit(0).withColumnRenamed("text", "content").drop("status").write.parquet(str(tmp_path / "formatted_pages.parquet"))
    kept = {r["page_id"] for r in residue.host_records(spark, str(tmp_path), True).filter("text is not null").collect()}
    assert 20 < len(kept) < 200
    got = residue.p3_validation(spark, str(tmp_path)).collect()
    assert sum(r["n_segments"] for r in got) == 10 * len(kept) and {r["label"] for r in got} == {"text"}


# encoding


@pytest.fixture(scope="module")
def bigrams() -> encoding.Bigrams:
    texts = ["Der Gärtner prüft die Brücke über den Fluß und schützt das Geräusch. Die Überschrift verändert sich täglich.", "Le théâtre protège la façade à l’été, où l’école répond déjà. « Très bien »", "Совет заменяет расписание и хранит черновик поздно вечером. Библиотека открывает раздел.", "图书馆保存了旧记录，学校改变了方法。", "The canal keeps the narrow path – for most of the year."]
    return encoding.Bigrams(texts * 20)


@pytest.mark.parametrize(("text", "read", "written"), [("Der Gärtner prüft die Brücke", "cp1252", "utf-8"), ("Le théâtre protège la façade", "mac_roman", "utf-8"), ("Совет заменяет расписание", "cp1252", "cp1251"), ("图书馆保存了旧记录", "cp1252", "utf-8"), ("Der Gärtner prüft die Brücke", "cp850", "cp1252")])
def test_readings_round_trip(bigrams, text: str, read: str, written: str) -> None:  # noqa: ANN001
    garbled = "".join(encoding._char_of(read)[b] for b in text.encode(written))
    swap, gain = encoding.readings(garbled, bigrams)[0]
    assert encoding.reread(garbled, swap) == text and gain > 5
    assert not [g for _, g in encoding.readings(text, bigrams) if g > 3]
    assert "".join(c for _, c in encoding.symbols(garbled, swap)) == text


@pytest.mark.parametrize("text", ["Der Gärtner prüft den Garten", "Il protège la ville"])
def test_lone_accents_read_by_a_wide_page(bigrams, text: str) -> None:  # noqa: ANN001
    garbled = text.encode().decode("gbk")
    assert not encoding._PAIR.search(garbled)  # a letter of two bytes is one character
    swap, gain = encoding.readings(garbled, bigrams)[0]
    assert swap == "gbk>utf-8" and encoding.reread(garbled, swap) == text and gain > 5


def test_table_is_learned(bigrams) -> None:  # noqa: ANN001
    text = "der gärtner prüft die brücke über den fluß " * 30
    swap = {"ä": "1", "ü": "2", "ß": "3"}
    seen = [("é" if c == "ä" else "ñ" if c == "ü" else c) for c in text]
    pairs: dict = {}
    for a, b in zip(seen, seen[1:], strict=False):
        pairs[a, b] = pairs.get((a, b), 0) + 1.0
    start = {c: c for c in set(seen)} | {"é": "ä", "ñ": "ü"}
    learned = encoding.fit_table(pairs, start, bigrams)
    assert learned["é"] == "ä" and learned["ñ"] == "ü" and all(learned[c] == c for c in set(seen) if c.isascii())
    assert swap


def test_found_lines(spark, bigrams) -> None:  # noqa: ANN001
    good = "Der Gärtner prüft die Brücke"
    bad = good.encode().decode("cp1252")
    rows = [("f", 1, "s", f"{good}\n{bad}"), ("f", 2, "s", good), ("f", 3, None, bad), ("f", 4, "s", "lost �"), ("f", 5, "s", ""), ("f", 6, "s", "plain ASCII " * 50_000), ("f", 1, "s", f"{good}\n{bad}")]
    df = spark.createDataFrame(rows, "field_name string, page_id long, source string, text string")
    restored = {(r["page_id"], r["line_no"]): r["restored"] for r in encoding.affected_lines(df, bigrams).collect()}
    assert restored == {(1, 1): good, (3, 0): good, (4, 0): None}
    assert encoding.affected_lines(df.limit(0), bigrams).count() == 0


@pytest.fixture(scope="module")
def corpus_bigrams(spark) -> encoding.Bigrams:  # noqa: ANN001
    return encoding.fit_bigrams(spark, "/root/testdata/sf0.01")


def test_bigrams_count_all_texts(spark, corpus_bigrams, tmp_path) -> None:  # noqa: ANN001
    """Pairs are counted over whole tables: one that a single record of many holds is known, and garbled lines aren't counted."""
    lines = ["the canal keeps its path 12", "für die Brücke", "", "Ⓐb Ⓐ"]
    counted = {(chr(a), chr(b)): n for a, b, n in zip(*(x.tolist() for x in encoding.pair_counts(lines)), strict=True)}
    expected: dict = {}
    for t in lines:
        t = "".join("0" if c.isdigit() else c for c in f"\n{t}\n")
        for p in zip(t, t[1:], strict=False):
            expected[p] = expected.get(p, 0) + 1
    joins = counted.pop(("\n", "\n")), expected.pop(("\n", "\n"))
    assert counted == expected and joins == (1, 1)

    documents = spark.createDataFrame([(i, "de-AT" if i % 2 else "de", "Der Gärtner prüft die Brücke über den Fluß." + (" Ⓐ" if i == 17 else "")) for i in range(600)], "doc_id long, lang string, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("de",)], "bcp47 string").write.parquet(str(tmp_path / "languages.parquet"))
    rows = [(i, f"https://h{i % 9}.example", "The canal keeps its path." + ("\nⒷ Home" if i == 4321 else "") + ("\nDer Gärtner prüft die Brücke".encode().decode("cp1252") if i == 5 else ""), "t") for i in range(8000)]
    spark.createDataFrame(rows, "page_id long, url string, text string, title string").write.parquet(str(tmp_path / "snapshots.parquet"))
    spark.createDataFrame(rows[:1], "page_id long, url string, text string, title string").write.parquet(str(tmp_path / "formatted_pages.parquet"))
    chars = set(encoding.fit_bigrams(spark, str(tmp_path)).chars)
    assert {"Ⓐ", "Ⓑ", "ß"} <= chars and "Ã" not in chars


def held_out(spark, lang: str, n: int) -> list[str]:  # noqa: ANN001
    """Lines of documents of one language."""
    from pagewright.storage import table

    docs = table(spark, "/root/testdata/sf0.1", "documents").filter(f"lang = '{lang}' and doc_id > 5000").orderBy("doc_id").limit(60).collect()
    lines = [x for d in docs for x in (d["text"] or "").split("\n") if sum(not c.isascii() for c in x) >= (20 if lang in ("ru", "ar") else 2)]
    return list(dict.fromkeys(lines))[:n]


UNLISTED = [("ru", "cp1251", "mac_cyrillic"), ("ru", "cp1251", "cp855"), ("ru", "cp855", "cp1252"), ("ru", "cp1251", "cp1256"), ("ru", "koi8_r", "cp1253")]
LISTED = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("ja", "shift_jis", "cp1252"), ("zh", "utf-8", "cp437"), ("es", "cp1252", "cp850")]


def planted(spark, swaps, n: int) -> tuple:  # noqa: ANN001
    """(records, original lines by page): each swap on a source of its own, with as many clean lines of other pages."""
    rows, original = [], {}
    for k, (lang, written, read) in enumerate(swaps):
        for i, line in enumerate(held_out(spark, lang, 2 * n)):
            page = 1000 * k + i
            try:
                seen = line if i % 2 else "".join(encoding._char_of(read)[b] for b in line.encode(written))
            except UnicodeEncodeError:
                continue
            if "\n" in seen or "\ufffd" in seen:
                continue
            rows.append(("f", page, f"s{k}.example", seen))
            if not i % 2:
                original[page] = line
    return spark.createDataFrame(rows, "field_name string, page_id long, source string, text string"), original


@pytest.mark.parametrize(("swaps", "least_found", "least_exact"), [(UNLISTED, 0.95, 0.6), (LISTED, 0.97, 0.9)])
def test_planted_swaps_are_found_and_restored(spark, corpus_bigrams, swaps, least_found: float, least_exact: float) -> None:  # noqa: ANN001
    df, original = planted(spark, swaps, 60)
    got = {r["page_id"]: r["restored"] for r in encoding.affected_lines(df, corpus_bigrams).collect()}
    found = [p in got for p in original]
    exact = [got.get(p) == line for p, line in original.items()]
    false = [p for p in got if p not in original]
    by = {s: (round(float(np.mean([p in got for p in original if p // 1000 == k])), 3), round(float(np.mean([got.get(p) == x for p, x in original.items() if p // 1000 == k])), 3)) for k, s in enumerate(swaps)}
    right = np.mean([a == b for p, x in original.items() if len(got.get(p) or "") == len(x) for a, b in zip(got[p], x, strict=True) if not b.isascii()])
    assert right >= 0.98 and np.mean(found) >= least_found and np.mean(exact) >= least_exact and len(false) <= 0.01 * len(original), (by, false)


# main body


def test_main_body(spark) -> None:  # noqa: ANN001
    rows = []
    for p in range(30):
        body = "\n\n".join(f"Paragraph tells of {''.join('abcdefghij'[int(d)] for d in str(1000 + p * 3 + k))} that no other does." for k in range(3))
        rows.append((p, "https://s.example/a", f"*   [Home](https://s.example/0)\n*   [News](https://s.example/1)\n\nBy Ann Writer{p % 3} · 2021-01-0{p % 9 + 1}\n\n# Title {'xyzuvw'[p % 6]}{p} of it all\n\n{body}\n\nSHARE  this story with all\n\n### Related stories\n*   [Story {p}](https://s.example/{p})\n\nLog in to leave a comment\nSome Reader: I like {p}"))
    rows += [rows[0], (90, "https://s.example/b", None), (91, None, "alone"), (92, "https://t.example", ""), (93, "https://s.example/c", "word " * 100_000)]
    df = pages(spark, rows)
    parsed = main_body.parsed_pages(df).cache()
    out = {tuple(r) for r in main_body.outside_lines(parsed, main_body.host_templates(parsed)).collect()}
    for p, _, content in rows[:30]:
        expected = {i for i, x in enumerate(content.split("\n")) if x.strip() and not x.startswith(("# ", "Paragraph"))}
        assert {i for q, i in out if q == p} == expected
    assert not [q for q, _ in out if q >= 90]
    articles = {r["page_id"]: r["content"] for r in main_body.main_bodies(df).collect()}
    assert "Paragraph tells" in articles[3] and "Related" not in articles[3] and articles[90] is None
    assert main_body.main_bodies(df.limit(0)).count() == 0


# language


def test_languages(spark, data) -> None:  # noqa: ANN001
    from pagewright.storage import table

    profiles = language.fit_profiles(spark, data)
    docs = [r for r in table(spark, data, "documents").select("lang", "text").collect() if r["lang"] in ("en", "de", "fr", "es", "ja", "ru") and r["text"] and len(r["text"]) > 300]
    model = language.Profiles(profiles)
    best = model.best([r["text"] for r in docs])[0]
    assert np.mean([model.languages[b] == r["lang"] for b, r in zip(best, docs, strict=True)]) > 0.85
    by = {r["lang"]: r["text"] for r in docs}
    line = max(by["de"].split("\n"), key=len)
    rows = [(1, "u", by["en"] + "\n\n" + line), (1, "u", by["en"] + "\n\n" + line), (2, "u", None), (3, "u", ""), (4, "u", "123 ... \n"), (5, "u", by["ru"] * 30)]
    got = {r["page_id"]: r for r in language.page_languages(pages(spark, rows), profiles).collect()}
    assert got[1]["main"] == "en" and [x["lang"] for x in got[1]["passages"]] == ["de"] and got[5]["main"] == "ru"
    assert got[2]["main"] is got[3]["main"] is got[4]["main"] is None
    assert language.page_languages(pages(spark, rows).limit(0), profiles).count() == 0
    assert language.base_language("pt_BR", {"pt"}) == "pt" and language.base_language("xx", {"pt"}) is None


# packing and mixing


def test_best_two_fit() -> None:
    assert sorted(map(sorted, packing.best_two_fit([6, 5, 3, 2], 10))) == [[2, 3, 5], [6]] or sum(map(sum, packing.best_two_fit([6, 5, 3, 2], 10))) == 16
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.choice([8, 100, 2048])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        bins = packing.best_two_fit(sizes, capacity)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(0 < sum(b) <= capacity for b in bins)
        assert len(bins) <= 1.25 * sum(sizes) / capacity + 2 or capacity == 8
    assert packing.best_two_fit([], 10) == []


def test_pack(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 5, 60, 99, 100, 101, 350]), 1) for i in range(500)] + [(900, None, 1), (901, 0, 1), (0, 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, shard int")
    capacities = spark.createDataFrame([(1, 100), (2, 400)], "pack_id int, capacity_tokens int")
    got = packing.pack(docs, capacities, shard=200).collect()
    for pack_id, capacity in ((1, 100), (2, 400)):
        own = [r for r in got if r["pack_id"] == pack_id]
        assert sum(r["n_tokens"] for r in own) == sum(s or 0 for _, s, _ in rows)
        full: dict = {}
        for r in own:
            full[r["container"]] = full.get(r["container"], 0) + r["n_tokens"]
        assert max(full.values()) <= capacity and sum(full.values()) > 0.9 * capacity * len(full)
        whole = {i for i, s, _ in rows if s and s <= capacity and i != 0}
        assert not [r for r in own if r["doc_id"] in whole and r["part"] > 0]
    assert packing.pack(docs.limit(0), capacities).count() == 0


def test_poisson() -> None:
    assert mixing.expected_uses(1.0, 50) == pytest.approx(1.0)
    for uses, repeats in ((0.3, 1), (0.95, 1), (1.7, 2), (2.9, 4)):
        assert mixing.expected_uses(mixing.mean_for(uses, repeats), repeats) == pytest.approx(uses, abs=1e-6)


def test_mix(spark) -> None:  # noqa: ANN001
    rng = random.Random(6)
    rows = [(i, "big" if i % 10 else "small", rng.randint(10, 200), 1) for i in range(6000)] + [(9000, None, 10, 1), (9001, "other", 10, 1), (9002, "big", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copy int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 1)], "source string, target_share double, max_repeats int")
    mixture = mixing.mix(docs, targets).cache()
    shares = {r["source"]: r for r in mixing.shares(mixture, targets).collect()}
    assert shares["small"]["actual_share"] == pytest.approx(0.4, abs=0.01) and shares["big"]["actual_share"] == pytest.approx(0.6, abs=0.01)
    assert shares["small"]["most_repeats"] <= 3 and shares["big"]["most_repeats"] == 1 and shares["absent"]["n_uses"] == 0
    assert mixture.exceptAll(mixing.mix(docs, targets)).count() == 0  # the same again
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixture.select(F.countDistinct("source")).first()[0] == 2


# templates of sites and hosts


def test_template_slots_are_merged_in_any_order(spark) -> None:  # noqa: ANN001
    """Lines of one leaf that differ in a word make a slot, and are told apart by what fills it."""
    rows = [(p, "https://a.example", f"Written and edited by {'Ann' if p % 2 else 'Bob'} in town\nWritten and edited by X{p}y for us") for p in range(40)]
    found = site_lines.site_rows(pages(spark, rows), "content", "url", "page_id").repartition(5)
    leaves = site_lines.tree_leaves(found)
    assert {r["n"] for r in leaves.collect()} == {40}
    lines = site_lines.leaf_lines(found, leaves.select("site", "path"))
    slots = sorted(r["slots"] for r in site_lines.merged_templates(lines).collect())
    assert slots == [[4], [4]] or slots == [[4, 5, 6]] or len(slots) == 2
    got = {tuple(r) for r in site_lines.repeated_lines(pages(spark, rows)).collect()}
    assert {(p, 0) for p in range(40)} <= got


def test_line_tokens() -> None:
    assert site_lines.line_tokens("Terms  OF use\x1c2021", 3) == ["terms", "of", "use\x1c0"] and site_lines.line_tokens("ab 12", 3) is None
    assert site_lines.tree_path(["page", "0", "of", "x"]) == site_lines.tree_path(["page", "0", "of", "y"]) != site_lines.tree_path(["page", "0", "of"])


def host_pages(block) -> list[tuple]:  # noqa: ANN001
    """Pages of one host; block(p) gives the lines below the article of page p."""
    return [(p, "https://s.example/a", f"# Title {'abcdefghij'[p % 10] * 3}{'abcdefghij'[p // 10] * 4} here\n\nBody text of page {chr(97 + p % 26) * 4} {chr(97 + p // 26) * 5} alone\n\n" + "\n\n".join(block(p))) for p in range(100)]


def outside(spark, rows, snapshots=None) -> set[tuple]:  # noqa: ANN001
    parsed = main_body.parsed_pages(pages(spark, rows)).cache()
    return {tuple(r) for r in main_body.outside_lines(parsed, main_body.host_templates(parsed, snapshots)).collect()}


def test_classes_decide(spark) -> None:  # noqa: ANN001
    """Two lines on the same 5 % of pages are a large class and template; on different pages, or in changing order, they aren't."""
    together = outside(spark, host_pages(lambda p: ["First line of notice", "Second line of notice"] if p % 20 == 0 else ["Own words"] * 0))
    assert {p for p, _ in together} == {p for p in range(100) if p % 20 == 0} and len(together) == 10
    apart = outside(spark, host_pages(lambda p: ["First line of notice"] if p % 20 == 0 else ["Second line of notice"] if p % 20 == 1 else []))
    mixed = outside(spark, host_pages(lambda p: ["First line of notice", "Second line of notice"][:: 1 if p % 40 else -1] if p % 20 == 0 else []))
    assert not apart and not mixed


def test_slots_decide(spark) -> None:  # noqa: ANN001
    """A frequent line without a fixed place around the title isn't nested in the template; what stands before the title is outside."""
    rows = [(p, u, ("Wandering words\n\n" + c) if p % 2 else c + "\n\nWandering words") for p, u, c in host_pages(lambda p: ["Footer words"])]
    got = outside(spark, rows)
    assert {n for p, n in got if p % 2} == {0, 6} and {n for p, n in got if p % 2 == 0} == {4}


def test_markup_tells_data_from_template(spark) -> None:  # noqa: ANN001
    """A shared subheading fills the data slot of the host's subheadings; the footer has a path of its own."""
    rows = host_pages(lambda p: ["## Shared subheading" if p % 3 == 0 else f"## Subheading {chr(97 + p % 26) * 3} {chr(97 + p // 26) * 3}", "Footer words"])
    html = [("https://s.example/a", "<html><head><title>x</title></head><body><main><h1>T</h1>" + c.split("\n\n")[2].replace("## ", "<h2>") + "</h2></main><div id=foot>Footer words</div></body></html>", p) for p, _, c in rows]
    snapshots = spark.createDataFrame([*html, ("https://s.example/a", None, 1), (None, "<p>x", 2), ("https://s.example/a", "", 3)], "url string, html string, site long")
    assert {n for _, n in outside(spark, rows, snapshots)} == {6} and {n for _, n in outside(spark, rows)} == {4, 6}
