"""One consistent form for texts that look alike but use different characters (problem 3).

A change is due for letters that are not composed (NFC), full-width forms, joined Latin
letters, invisible characters, blanks other than the plain blank, tab and line ends, and
letters that stand in for a Latin letter of the same look.  Words wholly in another script,
symbols, fractions, superscripts, quotes, dashes and ellipses stay as they are.

``consistent`` does this for one text inside a Python worker; ``consistent_form`` does it for
a table in SQL, by grouping look-alike-mapped words under an accent-sensitive collation.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Letters of other scripts and the Latin letters of the same look.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜ" + "асԁеһіјӏоԛрѕѵԝхуү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ" + "αικνορυχγϲ",
        "ABESIJKMHOPCTYXYGQW" + "acdehijloqpsvwxyy" + "ABEZHIKMNOPTYXCj" + "aikvopuxyc",
    )
)
# Latin letters that stand in for the Vietnamese D with stroke.
STROKED = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ"}
# Joined Latin letters.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ",
    "ǆ": "dž", "ǅ": "Dž", "Ǆ": "DŽ", "ǉ": "lj", "ǈ": "Lj", "Ǉ": "LJ", "ǌ": "nj", "ǋ": "Nj", "Ǌ": "NJ",
    "ǳ": "dz", "ǲ": "Dz", "Ǳ": "DZ",
}
# Characters that show nothing, as ranges of code points.
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
]
# Blanks and line ends that become a plain blank and a line feed.
BLANKS = "\x0b\x0c\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
LINE_ENDS = "\x85\u2028\u2029"

_ONE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | STROKED | dict.fromkeys(BLANKS, " ") | dict.fromkeys(LINE_ENDS, "\n")
_GONE = [chr(c) for a, b in INVISIBLE for c in range(a, b + 1)]
_FORM = str.maketrans(_ONE | JOINED | dict.fromkeys(_GONE))
_ASCII_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ODD = re.compile("[" + "".join(map(re.escape, [*_ONE, *JOINED, *_GONE])) + "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_RUN = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")
WORD = re.compile(r"[^\W_]+")


def _is_latin(letter: str) -> bool:
    return letter.isalpha() and ord(letter) < 0x250 and letter not in "µªº"


def _latinise(run: re.Match) -> str:
    """The run with look-alikes replaced, if it mixes them with Latin letters and has no other foreign ones."""
    if not _FOREIGN.search(run[0]):
        return run[0]
    apart = unicodedata.normalize("NFD", run[0])
    letters = [c for c in apart if not unicodedata.combining(c)]
    foreign = [c for c in letters if not _is_latin(c)]
    if len(foreign) == len(letters) or not all(c in LOOK_ALIKES for c in foreign):
        return run[0]
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in apart))


def consistent(text: str) -> str:
    """``text`` in the consistent form; it is its own form exactly if nothing had to be changed."""
    if text.isascii():
        return text.translate(_FORM) if _ASCII_ODD.search(text) else text
    if not _ODD.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    text = unicodedata.normalize("NFC", text.translate(_FORM))
    return _RUN.sub(_latinise, text) if _FOREIGN.search(text) else text


def words(text: str) -> list[str]:
    """The words of a text in order: runs of letters and digits of its consistent form, in lower case."""
    return WORD.findall(consistent(text).lower())


# -- the same in SQL ---------------------------------------------------------------------

#: Java character class of everything that may need a change; plain Latin and Vietnamese letters,
#: common punctuation and symbols are outside of it.
_SUSPECT = (
    "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\xa0\\xad\\xd0\\xf0\\u0132\\u0133\\u0180-\\u019f\\u01a2-\\u01ae\\u01b1-\\u1e9f"
    "\\u1efa-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u2126\\u212a\\u212b\\u2ade-\\uffff\\x{10000}-\\x{10ffff}]"
)
_UNSTABLE = "[\\u0300-\\u1dff\\u1f00-\\u1fff\\u2126\\u212a\\u212b\\u2ade-\\uffff\\x{10000}-\\x{10ffff}]"
_LETTERS = "[\\p{L}\\p{M}]"


def _full_look_alikes() -> dict[str, str]:
    """The look-alikes and, by rule, the composed letters that are a look-alike with accents."""
    full = dict(LOOK_ALIKES)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        apart = unicodedata.normalize("NFD", chr(code))
        if len(apart) > 1 and apart[0] in LOOK_ALIKES:
            full[chr(code)] = unicodedata.normalize("NFC", LOOK_ALIKES[apart[0]] + apart[1:])
    return full


def _character_forms(text: Column) -> Column:
    """What the form of a single character decides: width, joined letters, blanks, invisible characters."""
    for joined, apart in JOINED.items():
        text = F.replace(text, F.lit(joined), F.lit(apart))
    return F.translate(text, "".join([*_ONE, *_GONE]), "".join(_ONE.values()))


def _look_alike_mapped(run: Column) -> Column:
    """A run of letters with look-alikes replaced if it mixes them with Latin letters."""
    full = {k: v for k, v in _full_look_alikes().items() if len(v) == 1}
    foreign, known = "\\u0370-\\u03ff\\u0400-\\u052f\\u1f00-\\u1fff", "".join(full)
    mixed = run.rlike("[A-Za-z\\u00c0-\\u024f\\u1e00-\\u1eff]") & run.rlike(f"[{foreign}]") & ~run.rlike(f"[{foreign}&&[^{known}]]")
    return F.when(mixed, F.translate(run, known, "".join(full.values()))).otherwise(run)


@F.pandas_udf(StringType())
def _ordered(values: pd.Series) -> pd.Series:
    """Decomposed, so that the marks of a letter stand in canonical order, which collations expect."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFD", v))


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def consistent_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """The texts that need another form: ``(key, form, changed)``, one row per key with a suspicious text.

    Texts without a suspicious character are in consistent form already and give no row, so the
    rest of the table is only scanned.  Of the others, every distinct letter run with
    combining or foreign letters is a value; the values, look-alikes mapped, and their
    composed forms are grouped under the accent-sensitive collation UNICODE, in which canonically
    equal spellings are equal and accents and case are not; the canonical member of a class is
    the composed one (then the shortest, then the least by code points), and is joined back to
    the runs of each text.  ``changed`` tells whether the form differs from the text.

    Rows with the same key count once (they are expected to be equal); rows with a null key or
    text give none, as do empty texts.  Columns of ``df`` beyond the two are not read.
    """
    rows = (
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .where(F.col("_key").isNotNull() & F.col("_text").rlike(_SUSPECT))
        .dropDuplicates(["_key"])
    )
    pieces = rows.select(
        "_key",
        "_text",
        F.split(
            _character_forms(F.col("_text")),
            f"(?<={_LETTERS})(?!{_LETTERS})|(?<!{_LETTERS})(?={_LETTERS})",
        ).alias("_pieces"),
    ).withColumn("_runs", F.array_distinct(F.filter("_pieces", lambda p: p.rlike(_UNSTABLE))))
    runs = pieces.select("_key", F.explode("_runs").alias("_run"))
    mapped = runs.select("_run").distinct().withColumn("_mapped", _ordered(_look_alike_mapped(F.col("_run"))))
    members = (
        mapped.select("_mapped").distinct().withColumn("_nfc", _composed("_mapped"))
        .select(F.explode(F.array(F.struct(F.col("_mapped").alias("m"), (F.col("_mapped") != F.col("_nfc")).alias("loose")), F.struct(F.col("_nfc").alias("m"), F.lit(False).alias("loose")))).alias("_member"))
        .select(F.col("_member.m").alias("_value"), F.col("_member.loose").alias("_loose"))
    )
    canonical = members.groupBy(F.collate("_value", "UNICODE").alias("_class")).agg(
        F.min_by("_value", F.struct("_loose", F.length("_value"), "_value")).alias("_canonical")
    )
    forms = (
        mapped.withColumn("_class", F.collate("_mapped", "UNICODE"))
        .join(canonical, "_class")
        .select("_run", "_canonical")
    )
    exchange = runs.join(forms, "_run").groupBy("_key").agg(
        F.map_from_entries(F.collect_set(F.struct("_run", "_canonical"))).alias("_by_run")
    )
    form = F.array_join(
        F.transform("_pieces", lambda p: F.coalesce(F.try_element_at("_by_run", p), p)), ""
    )
    return (
        pieces.join(exchange, "_key", "left")
        .withColumn("form", F.when(F.col("_by_run").isNull(), F.array_join("_pieces", "")).otherwise(form))
        .select(F.col("_key").alias(key), "form", (F.col("form") != F.col("_text")).alias("changed"))
    )


#: The fields of problem 3: table, key, text.
FIELDS = (("train_data", "sample_id", "query"), ("temp_legal_corpus_withstpvl", "oid", "text"))


def p3_forms(spark, folder: str) -> DataFrame:
    """Every text of problem 3 that had to be changed, with its consistent form."""
    from corpusloom.session import table

    parts = []
    for name, key, text in FIELDS:
        forms = consistent_form(table(spark, folder, name), key, text).where("changed")
        parts.append(forms.select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), "form"))
    return parts[0].union(parts[1])


def p3_found(spark, folder: str) -> DataFrame:
    return p3_forms(spark, folder).select("tbl", "row_id")
