"""Problem 10: sentence units, in SQL expressions only.

Marks that don't end a sentence (in decimals, addresses, initials, abbreviations, quoted speech that goes on) are masked by a
private-use character of the same length, the text is split after the terminators of each script and at line breaks, and the
positions found hold in the original text, since masking never changes a length. Private-use characters that the text itself
holds in the few code points used here are replaced first, so that they can't be taken for marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import table

MASK, OPEN, CLOSE, CUT = "\ue0f0", "\ue0f1", "\ue0f2", "\ue0f3"

# Abbreviations that never end a sentence, without their last dot.
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "No", "Nos", "Fig", "fig", "vs", "pp", "p", "vol", "Vol", "ed", "eds", "approx", "dept", "Gen", "Sen", "Rep", "Rev", "Capt", "Sgt", "Lt", "Col",
    "Nr", "bzw", "ca", "vgl", "Abs", "Bd", "Hr", "Fr", "sog", "ggf", "evtl", "inkl", "zzgl", "Abb", "Tab", "Kap", "Str", "Mio", "Mrd",
    "M", "MM", "cf", "env", "art", "Art", "chap", "éd", "av", "tél", "réf",
    "Sr", "Sra", "Srta", "Sres", "Dra", "núm", "Núm", "pág", "págs", "aprox", "Ud", "Uds", "cap", "tel", "Lic", "Ing", "Arq",
    "Exmo", "Exma", "Eng", "Prof", "Profa",
    "sig", "Sig", "dott", "Dott", "prof", "ing", "avv", "cfr", "pag", "pagg", "num", "tav", "ecc",
    "dhr", "mevr", "Dhr", "Mevr", "bijv", "blz", "nr", "resp", "incl", "excl", "afb", "hfst",
    "см", "См", "рис", "Рис", "стр", "табл", "гл", "ул", "им", "проф", "акад", "тов", "гг", "тыс", "млн", "млрд", "руб", "напр", "ср",
    "डॉ", "श्री", "प्रो", "पं", "कु", "د", "أ", "م", "ص", "نسخ",
]
# German months, before which a number with a dot is an ordinal.
ORDINAL_NEXT = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Kapitel|Auflage"

#: Characters that aren't part of a unit at its end.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_STOP = ".!?…؟।॥۔。！？｡"
_BLANK = r"[ \t\u00a0\u2000-\u200b\u202f\u3000]"


def _speech(opening: str, closing: str, goes_on: str) -> tuple[str, str]:
    """Masks every terminator of a quotation that `goes_on` follows, one match after another from its opening mark on."""
    inner = rf"[^{opening}{closing}{OPEN}{CLOSE}\n]*+"
    starts = rf"(?:{opening}(?={inner}{closing}{goes_on})|(?!^)\G)"
    return rf"({starts}[^{opening}{closing}{OPEN}{CLOSE}\n{_STOP}]*+)[{_STOP}]", f"$1{MASK}"


def _mask_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs; each replacement has the length of what it replaces.

    Patterns begin with the rare mark itself and look behind it, so that the other characters are passed over quickly.
    """
    words = "|".join(sorted(set(ABBREVIATIONS), key=lambda w: (-len(w), w)))
    edge = rf"(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}{MASK}])"
    part = r"(?:\p{L}|ex|ej|es|dgl)"
    goes_on = rf"{_BLANK}*[\p{{Ll}}\p{{Lo}}—–,，、،]"
    return [
        # dots between letters or digits: decimals, versions, file names, hosts
        (r"\.(?=[\p{L}\p{Nd}])(?<=[\p{L}\p{Nd}]\.)", MASK),
        # initials and abbreviations in several parts, as in z. B. and p. ex., but for a.m. and p.m. at the end of a sentence
        (rf"\.(?={_BLANK}?{part}[.{MASK}])(?<={edge}\p{{L}}\.)", MASK),
        (rf"\.(?={_BLANK})(?<=(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}'’])\p{{Lu}}\.)", MASK),
        (rf"\.(?={_BLANK}*[^\s])(?<={edge}\p{{L}}{MASK}{_BLANK}?{part}\.)(?<![aApP]{MASK}{_BLANK}?[mM]\.)", MASK),
        (rf"\.(?={_BLANK})(?<={edge}(?:{words})\.)", MASK),
        (rf"\.(?={_BLANK}(?:{ORDINAL_NEXT})\b)(?<=\p{{Nd}}\.)", MASK),
        # a quotation that a colon introduces ends its sentence; its marks are set apart from those of speech that goes on
        (rf"“(?<=[:：]{_BLANK}?“)([^“”\n]*)”", f"{OPEN}$1{CLOSE}"),
        (rf"«(?<=[:：]{_BLANK}?«)([^«»\n]*)»", f"{OPEN}$1{CLOSE}"),
        # speech that goes on: 「…」と, and “…” or «…» with more of the sentence behind it
        _speech("「", "」", "(?:と|って|、|，|など|は|が|を)"),
        _speech("『", "』", "(?:と|って|、|，|など|は|が|を)"),
        _speech("“", "”", goes_on),
        _speech("«", "»", goes_on),
    ]


def _cut_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs that put a CUT behind each unit."""
    closers = rf"[”“»’\"')\]」』）{CLOSE}]"
    starts = r"\p{Lu}\p{Lt}\p{Lo}\p{Nd}¿¡«“„‘\"'(\[「『" + OPEN
    return [
        (rf"([.!?…؟।॥۔]+(?:{closers}+|{_BLANK}[»{CLOSE}])?)(?={_BLANK}+[{starts}])", f"$1{CUT}"),
        (rf"([。！？｡]+[”»’\"')\]」』）{CLOSE}]*)", f"$1{CUT}"),
        (rf"({_BLANK})(?<=[฀-๿].)(?={_BLANK}*[฀-๿])", f"{CUT}$1"),
        (r"([\n\r\u2028\u2029\u0085]+)", f"{CUT}$1"),
    ]


def unit_ends(text: Column) -> Column:
    """Array of the end positions of the sentence units of `text`, in characters; null for null, empty for blank text."""
    out = F.translate(text, MASK + OPEN + CLOSE + CUT, "\ufffd" * 4)
    for pattern, to in _mask_steps() + _cut_steps():
        out = F.regexp_replace(out, pattern, to)
    pieces = F.split(out, CUT)

    def step(acc: Column, piece: Column) -> Column:
        body = F.length(F.rtrim(piece, F.lit(BLANKS)))
        ends = F.when(body > 0, F.array_append(acc["ends"], (acc["at"] + body).cast("int"))).otherwise(acc["ends"])
        return F.struct((acc["at"] + F.length(piece)).cast("int").alias("at"), ends.alias("ends"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["ends"])


def split_sentences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, unit, end_pos, sentence): one row for each sentence unit.

    A null, empty or blank text has no units. Repeated rows give repeated units. Text of any length is taken whole. Other
    columns don't take part.
    """
    found = docs.select(F.col(id_column), F.col(text_column).alias("_text"), unit_ends(F.col(text_column)).alias("_ends"))
    units = found.select(id_column, "_text", "_ends", F.posexplode("_ends").alias("unit", "end_pos"))
    start = F.when(F.col("unit") == 0, F.lit(0)).otherwise(F.get("_ends", F.col("unit") - 1))
    sentence = F.regexp_replace(F.substring(F.col("_text"), start + 1, F.col("end_pos") - start), r"(?U)^\s+", "")
    return units.select(id_column, "unit", "end_pos", sentence.alias("sentence"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, end_pos) of every sentence unit."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(unit_ends(F.col("text"))).alias("end_pos"))


QUERIES = {"p10_found": p10_found}
