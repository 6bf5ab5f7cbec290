"""Scalar functions on texts as Spark columns; what Spark lacks is an Arrow UDF at the end."""
from __future__ import annotations

import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

NOT_WORD = r"[^\p{L}\p{N}_]"
# Punctuation of other scripts and its plain form.
PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"',
    "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ",
    "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
# Words that retrieval by terms ignores.
STOP_WORDS = [
    "của", "và", "các", "có", "được", "theo", "tại", "trong", "về", "hoặc", "người", "này", "khoản", "cho", "không", "từ", "phải",
    "ngày", "việc", "sau", "để", "đến", "bộ", "với", "là", "năm", "khi", "số", "trên", "khác", "đã", "thì", "thuộc", "điểm", "đồng",
    "do", "một", "bị", "vào", "lại", "ở", "nếu", "làm", "đây", "như", "đó", "mà", "nơi", "”", "“", '"',
]
ASCII_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """Lower-cased parts between non-word characters, empty ones included."""
    return F.split(F.lower(text), NOT_WORD, -1)


def words(text: Column) -> Column:
    """Distinct lower-cased words in order of appearance."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t != ""))


def numbered_words(text: Column) -> Column:
    """Distinct words with the blanks and digits that follow, in their case, as verification compares them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+ *\p{Nd}*)"), 1))


def long_enough(text: Column, least: int = 5) -> Column:
    """At least ``least`` parts between non-word characters, empty ones included."""
    return F.size(tokens(text)) >= least


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(parts: Column, n: int = 5, least: int = 5) -> Column:
    """Runs of ``n`` parts joined by blanks; none below ``least`` parts, all parts together if there are fewer than ``n``."""

    def of(p: Column) -> Column:
        sliding = F.transform(F.sequence(F.lit(0), F.size(p) - n), lambda i: F.array_join(F.slice(p, i + 1, n), " "))
        short = F.when(F.size(p) < n, F.array(F.array_join(p, " "))).otherwise(sliding)
        return F.when(F.size(p) < least, F.array().cast("array<string>")).otherwise(short)

    return bound(parts, of)


def shingles(text: Column, n: int = 5, least: int = 5) -> Column:
    """Distinct lower-cased n-grams of the non-empty words."""
    return F.array_distinct(ngrams(F.filter(tokens(text), lambda t: t != ""), n, least))


def plain_punctuation(text: Column) -> Column:
    """Punctuation of other scripts in plain form."""
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for mark, plain in PUNCTUATION.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def without_punctuation(text: Column) -> Column:
    return F.translate(text, "".join(PUNCTUATION), "")


def normalize_text(text: Column, lower: bool = False, accents: bool = True, numbers: bool = True, punctuation: int = 1) -> Column:
    """Strip, optionally lower-case and unaccent, digits to 0, punctuation plain (1), gone (2) or kept (0), no control characters."""
    text = F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    text = F.lower(text) if lower else text
    text = text if accents else strip_accents(text)
    text = F.regexp_replace(text, r"\p{Nd}", "0") if numbers else text
    text = plain_punctuation(text) if punctuation == 1 else without_punctuation(text) if punctuation == 2 else text
    return F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", "")


def printable(text: Column) -> Column:
    """Characters of the categories C* as blanks."""
    return F.regexp_replace(text, r"\p{C}", " ")


def collapse(text: Column) -> Column:
    """Runs of blanks and of dots as one."""
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"\.+", ".")


def drop_blanks(text: Column) -> Column:
    """Without no-break and zero-width spaces."""
    return F.translate(text, "\u00a0\u200b", "")


def plain_blanks(text: Column) -> Column:
    """No-break spaces as plain ones, no zero-width spaces."""
    return F.translate(text, "\u00a0\u200b", " ")


def strip_leading(text: Column) -> Column:
    """Without ASCII punctuation and blanks at the front."""
    return F.regexp_replace(text, f"^[{ASCII_PUNCTUATION} ]+", "")


def search_terms(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased words without punctuation and stop words, repeated ones kept."""
    ignored = ["", "_", *(STOP_WORDS if stop is None else stop)]
    return F.filter(tokens(text), lambda t: ~t.isin(ignored))


def parent_id(chunk: Column) -> Column:
    """The id without its last part after ``_``."""
    return F.regexp_replace(chunk, r"_[^_]*$", "")


def id_number(value: Column) -> Column:
    """The number behind the last ``_`` of an id; null if there is none."""
    return F.element_at(F.split(value, "_"), -1).try_cast("int")


def clean_url(url: Column) -> Column:
    return F.substring_index(url, "&mode", 1)


def url_id(url: Column) -> Column:
    """The part behind the last hyphen, up to the next dot."""
    return F.substring_index(F.substring_index(url, "-", -1), ".", 1)


def with_instruction(text: Column, instruction: str) -> Column:
    return F.concat(F.lit(instruction), text)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def seeded(seed: int, *keys) -> Column:
    """A number in [0, 1) that only depends on the keys and the seed: 48 bits of an MD5 digest, which any SQL engine can compute."""
    digest = F.md5(F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


# -- Arrow UDFs ------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Canonical decomposition without marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


_SPACED = [(re.compile(a), b) for a, b in ((r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", r")\1"), (r"\( ", "("), (r" \)", ")"), (r"(\d) %", r"\1%"), (r" :", ":"), (r" ;", ";"))]
_MARKS = str.maketrans({"`": "'", "„": '"', "“": '"', "”": '"', "–": "-", "‘": "'", "’": "'", "‚": "'", "´": "'", "«": '"', "»": '"', "…": "...", "—": " - "})


@F.pandas_udf(StringType())
def normalize_for_translation(text: pd.Series) -> pd.Series:
    """Spacing around punctuation made regular, quotes and dashes plain, no unprintable characters, then NFKC."""

    def one(t):
        if t is None:
            return None
        for pattern, plain in _SPACED:
            t = pattern.sub(plain, t)
        t = "".join(" " if unicodedata.category(c)[0] == "C" else c for c in t.translate(_MARKS))
        return unicodedata.normalize("NFKC", t)

    return text.map(one)


_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+(?=[\"“‘(\[]?[\w\d])")
_PARTS = StructType([StructField("sentences", ArrayType(StringType())), StructField("fillers", ArrayType(StringType()))])


def align_fillers(text: str, sentences: list[str], ignore_errors: bool = False) -> list[str]:
    """What stands before, between and after the sentences that some splitter has found in a text.

    A sentence that is not in the rest of the text is an error, or with ``ignore_errors`` is taken to begin one
    character on.
    """
    fillers, at = [], 0
    for sentence in sentences:
        begin = text.find(sentence, at)
        if begin < 0:
            if not ignore_errors:
                raise ValueError(f"no such sentence behind place {at}: {sentence!r}")
            begin = at + 1
        fillers.append(text[at:begin])
        at = begin + len(sentence)
    return [*fillers, text[at:]]


def split_with_fillers(text: str, collapsed: bool = False) -> tuple[list[str], list[str]]:
    """Sentences and what stands before, between and after them; joined alternately they give the text, with runs of
    blanks and dots as one first if ``collapsed``."""
    text = re.sub(r"\.+", ".", re.sub(" +", " ", text)) if collapsed else text
    sentences, fillers, at = [], [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        kept = part.strip()
        lead = part[: len(part) - len(part.lstrip())]
        if kept:
            fillers.append((fillers.pop() if len(fillers) > len(sentences) else "") + lead)
            sentences.append(kept)
            tail = part[len(lead) + len(kept) :]
        else:
            tail = part
        tail += m[0] if m else ""
        if len(fillers) > len(sentences):
            fillers[-1] += tail
        else:
            fillers.append(tail)
        at = m.end() if m else end
    return sentences, fillers if fillers else [""]


@F.pandas_udf(_PARTS)
def sentences_with_fillers(text: pd.Series) -> pd.DataFrame:
    """One more filler than sentences; null texts have neither."""
    parts = [split_with_fillers(t) if t is not None else ([], []) for t in text]
    return pd.DataFrame({"sentences": [p[0] for p in parts], "fillers": [p[1] for p in parts]})


def chunk_text(text: str, size: int = 256, overlap: int = 10, separators=("\n\n", "\n", ".", " ", ""), length=len) -> list[str]:
    """Pieces of at most ``size`` by ``length``, cut at the first separator that helps, with ``overlap`` carried over."""

    def cut(part: str, level: int) -> list[str]:
        if length(part) <= size or level == len(separators):
            return [part]
        mark = separators[level]
        pieces = [p + (mark if i < part.count(mark) else "") for i, p in enumerate(part.split(mark))] if mark else list(part)
        found = []
        for p in pieces:
            found.extend(cut(p, level + 1) if length(p) > size else [p])
        return found

    chunks, held = [], []
    for piece in cut(text, 0):
        if held and length("".join(held)) + length(piece) > size:
            chunks.append("".join(held))
            while held and (length("".join(held)) > overlap or length("".join(held)) + length(piece) > size):
                held.pop(0)
        held.append(piece)
    if held:
        chunks.append("".join(held))
    return [c.strip() for c in chunks if c.strip()]


def chunks(size: int = 256, overlap: int = 10, separators=("\n\n", "\n", ".", " ", ""), length=len):
    """A UDF that cuts a text into chunks; null and blank texts have none."""

    @F.pandas_udf(ArrayType(StringType()))
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunk_text(t, size, overlap, separators, length) if t else [])

    return udf


def lengths(measure):
    """A UDF of text lengths by a callable, such as a tokenizer's; 0 for null."""

    @F.pandas_udf(IntegerType())
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: 0 if t is None else measure(t))

    return udf


def shuffled(probability: float = 0.5, seed: int = 0, least: int = 100):
    """A UDF that cuts some texts of more than ``least`` characters into three and shuffles the parts."""

    @F.pandas_udf(StringType())
    def udf(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None or len(t) <= least:
                return t
            rng = random.Random(f"{seed}:{t}")
            if rng.random() >= probability:
                return t
            step = len(t) // 3 + 1
            parts = [t[i : i + step] for i in range(0, len(t), step)]
            rng.shuffle(parts)
            return " ".join(parts)

        return text.map(one)

    return udf
