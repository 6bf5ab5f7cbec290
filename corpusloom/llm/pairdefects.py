"""Defective question-answer pairs by type (problem 5).

Answers without content, answers that only repeat the question, answers in another language and answers
that break off are told by checks of the pair itself.  Refusals are templates that come back
under unrelated prompts: the openings of answers, names and numbers masked, are linked if their two-word shingles reach a
similarity of 0.5, and clustered as connected components, all of them exactly.
An answer has two openings if a second clause begins among its first words ("sorry, I can't ..."); it is a refusal if one of them is.
A cluster is a refusal template if it stands under four or more prompts while its answers say nothing in particular: they
have hardly a name or number of their own, mostly none in the opening, and hardly a word of their prompts.  Legal formulas come back as often, but are full of
particulars; short answers ("yes", "no") have no opening long enough.  Clusters in between, whose answers
name somebody they say nothing about or that stand under two prompts only, are decided by whether most of them speak of the
answerer's own inability.  An answer whose openings nobody else uses is no refusal, whatever it says.
"""
from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm.textform import WORD, consistent
from corpusloom.llm.wordsets import starts
from corpusloom.operators.graph import connected_components
from corpusloom.plans.staging import stage
from corpusloom.plans.spreading import spread

#: Words of an opening, words of a shingle, and the similarity from which openings are alike.
#: One replaced word leaves n - 3 of n + 1 two-word shingles of an opening of n words, at least half from 7 words on.
OPENING_WORDS, SHINGLE, SIMILAR = 12, 2, 0.5
#: Shingles of a key. Shingles in more than 1 of FREQUENT_SHARE openings are ordered by frequency, all others come first.
TAKEN, FREQUENT_SHARE = 3, 2000
#: A template stands under so many prompts at least if its wording doesn't speak of inability, and its answers have so many words on average.
PROMPTS, LEAST_WORDS = 4, 8
#: Share of names and numbers among the words of a template's answers, and of words that also stand in the prompt: up to these a
#: template says nothing; up to VAGUE it is decided by its wording; openings beyond it, and of longer answers, are no candidates.
BARE, SHARED, VAGUE, LONGEST = 0.1, 0.25, 0.4, 80
_STEP = 2000

# What stands in place of an answer.
PLACEHOLDERS = frozenset(
    "n a|na|null|none|nil|nan|undefined|trống|rỗng|bỏ trống|để trống|đang cập nhật|chưa cập nhật|đang được cập nhật|nội dung đang được cập nhật|"
    "nội dung đang cập nhật|đang cập nhật nội dung|không có nội dung|chưa có nội dung|không có dữ liệu|chưa có dữ liệu|chưa có câu trả lời|không có câu trả lời|"
    "tbd|tba|todo|to be updated|to be determined|updating|no content|no answer|empty|blank|not available|not applicable|no data|content pending|pending|"
    "coming soon|lorem ipsum|xxx|placeholder|unknown|missing".split("|")
)
# Frequent words of the languages told apart; Vietnamese is told by its letters as well.
COMMON_WORDS = {
    "en": "the of and to in for is are was were be by or on at with from as that this which who must may can not no if it an any under before after has have had will shall does do "
    "their its you your we i our only when where how what between over within yes about above against all also among because been being below both but could does each either every few further "
    "he her here him his into itself just like me more most much my neither nor nothing other others out own same she should since so some such than them then there these they those "
    "through too until up upon us very was while whose why without would unless whether",
    "vi": "và của các có không được trong cho theo tại với khi từ này đến hoặc là thì người những về nếu do đối phải để năm ngày điều khoản",
    "fr": "le la les des du de et est un une dans pour par sur avec que qui ne pas au aux ce cette son ses leur il elle ou mais être sont doit peut avant après pendant toutefois selon d l s n",
    "es": "el la los las de del y que en un una por con para se su sus no es al lo como más pero o debe puede son está este esta",
    "de": "der die das und ist von den dem des ein eine in zu mit auf für nicht im sich auch als an werden wird oder aus bei nach wenn muss kann sind hat",
    "it": "il lo gli le di del della e che in un una per con non si è sono da al alla nel deve può come anche o",
    "pt": "o a os as de do da dos das e que em um uma por com para não se no na é são ao deve pode como mais ou",
}
_LANGUAGE = {}
for _code, _list in COMMON_WORDS.items():
    for _w in _list.split():
        _LANGUAGE.setdefault(_w, []).append(_code)
_VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
_SCRIPTS = [("zh", re.compile("[一-鿿]")), ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("th", re.compile("[฀-๿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("lo", re.compile("[຀-໿]")), ("km", re.compile("[ក-៿]")), ("el", re.compile("[Ͱ-Ͽ]"))]
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"|‘[^’]*’")
_STARTS = re.compile(r"(?:\A|[.!?:;\n])\s*([^\W\d_])")  # letters that begin a sentence
_TAG = re.compile(r"<[^<>]{0,200}>")

# An answerer that speaks of itself and declines.
_SELF = r"(?:tôi|tui|em|mình|chúng tôi|chúng em|bên em|bên mình|hệ thống|trợ lý ảo|ad|admin)"
_NOT = r"(?:không|ko|k|hông|hok|chưa|chẳng)"
DECLINE = re.compile(
    rf"\b{_SELF}\b[^.;!?\n]{{0,25}}\b{_NOT}\b (?:\w+ ){{0,2}}?(?:thể|rõ|biết|tìm thấy|tìm được|hỗ trợ|đủ|có đủ|có thông tin|được phép|bình luận|trả lời|giúp|tư vấn|dám|chắc|nắm|cung cấp)\b"
    rf"|\bcâu hỏi(?: này| của bạn)? (?:nằm |là )?ngoài (?:phạm vi|khả năng)"
    rf"|\b{_SELF}\b[^.;!?\n]{{0,20}}\bxin (?:phép {_NOT}|từ chối|được từ chối|miễn)\b|\b{_SELF} (?:xin )?từ chối (?:trả lời|bình luận|tư vấn)"
    r"|\b(?:i|we)\b[^.;!?\n]{0,25}\b(?:can't|cannot|can not|could not|couldn't|won't|will not|unable|not able|don't know|do not know|don't have|do not have|lack|must decline|have to decline|decline|am not allowed|are not allowed|not permitted|am not authorised|not qualified|not sure|would rather not|prefer not)\b"
    r"|\b(?:this|that|the|your) (?:question|request|topic) (?:is|falls|goes) (?:outside|beyond|out of)\b|\bno (?:suitable|matching) answer was found\b"
)
# Words after which a sentence can't be complete.
OPEN_ENDED = frozenset(
    "và hoặc của theo tại khi nếu với trong từ đến để bởi vì các những một như mà nhưng do về trên dưới giữa cùng gồm đối sau trước thuộc trừ bị được "
    "and or the of to for in at by with from an a if unless when where that which but as between under than into over is are was be must may can shall will".split()
)
_END = re.compile(r"[.!?…。！？]+$")
_CLOSERS = "\"'”’»)]}*_ \t\r\n"
_CUT = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\w\s*(?:\.\.\.|…))$")


def language_of(text: str) -> tuple[str, float]:
    """The likely language of a text and the share of its words that speak for it; ``und`` for too few words."""
    found = [w for w in WORD.findall(_QUOTED.sub(" ", text).lower()) if not w[0].isdigit()]
    if not found:
        return "und", 0.0
    votes: dict[str, float] = {}
    for code, script in _SCRIPTS:
        n = sum(1 for w in found if script.search(w))
        if n:
            votes[code] = n * 2.0
    for w in found:
        if _VIETNAMESE.search(w):
            votes["vi"] = votes.get("vi", 0.0) + 1.0
        for code in _LANGUAGE.get(w, ()):
            votes[code] = votes.get(code, 0.0) + 1.0
    if not votes:
        return "und", 0.0
    best = max(sorted(votes), key=votes.get)
    return best, votes[best] / len(found)


def is_empty(answer: str) -> bool:
    plain = _TAG.sub(" ", answer)
    said = " ".join(WORD.findall(plain.lower()))
    return not said or said in PLACEHOLDERS


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The answer has hardly a word of its own and most words of the question."""
    if not question or not answer:
        return False
    asked, said = set(question), set(answer)
    own = sum(1 for w in answer if w not in asked)
    return own <= max(2, 0.08 * len(answer)) and len(asked & said) >= 0.6 * len(asked) and (own == 0 or own / len(answer) <= 0.2)


def is_truncated(answer: str) -> bool:
    """The last sentence has no end, or ends in a word that must go on."""
    text = _TAG.sub(" ", answer).rstrip()
    if text.endswith(("v.v", "v.v.", "v.v...", "v.v…", "etc.", "etc")):
        return False
    if _CUT.search(text):
        return True
    closed = text.rstrip(_CLOSERS)
    ending = text[len(closed.rstrip()) :]
    complete = bool(_END.search(closed)) or any(m in ")]" for m in ending)
    if not complete:
        return True
    core = _END.sub("", closed).rstrip(_CLOSERS)
    found = WORD.findall(core)
    # a word that must go on, unless it is the end of a name
    return len(found) > 3 and found[-1] in OPEN_ENDED


def opening_of(answer: str) -> tuple[str, str, int]:
    """The first words of an answer with names and numbers masked, the same from its second clause if that begins
    among them, and how many names and numbers the whole answer has."""
    masked, previous, second = [], "", 0
    text = _QUOTED.sub(" ", answer)
    for m in WORD.finditer(text):
        w = m[0]
        before = text[max(0, m.start() - 4) : m.start()].rstrip(" ")[-1:]
        start = not masked or before in ".!?:;\n"
        mark = "#" if w[0].isdigit() else "N" if w[0].isupper() and w != "I" and not start else w.lower()
        if masked and not second and len(masked) < OPENING_WORDS and before in ",.!?:;\n":
            second = len(masked)
        if mark in "#N" and mark == previous:
            continue
        masked.append(mark)
        previous = mark
        if len(masked) == 2 * OPENING_WORDS:
            break
    marked = sum(1 for w in WORD.findall(text) if w[0].isdigit() or (w[0].isupper() and w != "I"))
    particular = max(marked - sum(1 for c in _STARTS.findall(text) if c.isupper()), 0)
    return " ".join(masked[:OPENING_WORDS]), " ".join(masked[second : second + OPENING_WORDS]) if second else "", particular


def declines(answer: str) -> bool:
    """The answerer speaks of its own inability in the first words."""
    text = " ".join(_QUOTED.sub(" ", answer).lower().replace("’", "'").split())
    found = DECLINE.search(text)
    return bool(found) and len(text[: found.start()].split()) <= 16


@dataclass
class Checked:
    """What a pair itself shows: its defect, and what tells whether its answer is of a refusal template."""

    defect: str | None
    opening: str = ""
    second: str = ""  # the opening of its second clause
    cue: bool = False  # the answerer speaks of its own inability
    words: int = 0
    particular: int = 0  # names and numbers
    shared: int = 0  # words of the prompt


def checked(question: str, asked: list[str], language: str, answer: str | None) -> Checked:
    if answer is None:
        return Checked("empty")
    text = consistent(answer)
    if is_empty(text):
        return Checked("empty")
    said = WORD.findall(text.lower())
    if is_copy(asked, said):
        return Checked("copy")
    opening, second, particular = opening_of(text)
    prompt = set(asked)
    found = Checked(None, opening, second, declines(text), len(said), particular, sum(w in prompt and len(w) > 1 for w in said))
    own, share = language_of(text)
    if not found.cue and language != "und" and own not in ("und", language) and share >= 0.1 and len(said) >= 4:
        theirs = sum(1 for w in said if language in _LANGUAGE.get(w, ())) + (sum(1 for w in said if _VIETNAMESE.search(w)) if language == "vi" else 0)
        if theirs == 0 or (share >= 0.2 and theirs / len(said) < 0.6 * share):
            found.defect = "other_language"
            return found
    if is_truncated(text) and not found.cue:
        found.defect = "truncated"
    return found


def _pairs(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            row, place, prompts, found = [], [], [], []
            for i, (question, answers) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                question = consistent(question) if question else ""
                if not question.strip():
                    continue
                asked = WORD.findall(question.lower())
                language = language_of(question)[0]
                prompt = xxhash.xxh3_64_intdigest(" ".join(asked)) >> 1
                judged = [checked(question, asked, language, a) for a in answers or ()] or [Checked("empty")]
                row += [i] * len(judged)
                place += range(1, len(judged) + 1) if answers else [0]
                prompts += [prompt] * len(judged)
                found += judged
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), pa.array(prompts, pa.int64()), pa.array([f.defect for f in found], pa.string()),
                    pa.array([f.opening for f in found], pa.string()), pa.array([f.second for f in found], pa.string()), pa.array([f.cue for f in found], pa.bool_()), *(pa.array([getattr(f, c) for f in found], pa.int32()) for c in ("words", "particular", "shared")),
                ],
                ["key", "pos_no", "prompt", "defect", "opening", "second", "cue", "words", "particular", "shared"],
            )


def _shingles(opening: str) -> list[str]:
    w = opening.split(" ")
    return [" ".join(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, 1))]


def _marked(batches):
    """Ids and the distinct shingles of openings, as hashes, with their number and the parities of 64 cells."""
    for batch in batches:
        lists = [sorted({xxhash.xxh3_64_intdigest(s) for s in _shingles(opening)}) for opening in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.array([h for x in lists for h in x], np.uint64)
        begin = starts(size)
        cells = np.bitwise_xor.reduceat(np.uint64(1) << (flat >> np.uint64(58)), begin[:-1]) if len(lists) else flat
        marks = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), marks, pa.array(size, pa.int32()), pa.array(cells.view(np.int64))], ["id", "marks", "n", "cells"])


def _keys(broadcast):
    """Keys that two openings of enough similarity have in common: three of the rarest shingles of an opening.

    A partner of an opening of n shingles has ceil(SIMILAR n) of them or more. If that is three or more for one of two openings, the first three
    shared ones, in an order that holds for all, have as many less three behind them, so they are among the first n - ceil(SIMILAR n) + 3 of each;
    two openings for which it is less share one of the first n - ceil(SIMILAR n) + 1.
    """

    def run(batches):
        frequent, rank = broadcast.value
        for batch in batches:
            size = batch.column(2).to_numpy()
            marks = batch.column(1).flatten().to_numpy()
            place = np.zeros(len(marks), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, marks), len(frequent) - 1)
                place = np.where(frequent[at] == marks, rank[at] + 1, 0)
            order = np.lexsort((marks, place, np.repeat(np.arange(len(size)), size)))
            marks, begin = marks[order].view(np.uint64), starts(size)[:-1]
            for n in np.unique(size).tolist():
                row = np.nonzero(size == n)[0]
                own = marks[begin[row][:, None] + np.arange(n)]
                least = math.ceil(SIMILAR * n)
                for taken in (1, TAKEN):
                    if taken > n or (taken < TAKEN and least >= TAKEN):
                        continue
                    choice = np.array(list(itertools.combinations(range(min(n, n - least + taken)), taken)))
                    key = np.full((len(row), len(choice)), taken, np.uint64)
                    for i in range(taken):
                        key = (key ^ own[:, choice[:, i]]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    ids = batch.column(0).take(pa.array(np.repeat(row, len(choice))))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(key.reshape(-1).view(np.int64))], ["id", "key"])

    return run


def opening_links(openings: DataFrame) -> DataFrame:
    """``(opening, head)``: edges between openings that connect those, and only those, that a chain of openings with a similarity of SIMILAR or more connects.

    Two similar openings share a key. First, all that have a key are compared with two of them, the least and the greatest by a hash that differs from
    key to key, so a key of n openings costs 2 n comparisons; that connects nearly all. Then whatever shares a key without being connected is
    compared, pair by pair.
    """
    spark = openings.sparkSession
    named = openings.select(F.xxhash64("opening").alias("id"), "opening")
    marked = stage(named.mapInArrow(_marked, "id long, marks array<long>, n int, cells long"))
    least = marked.count() / FREQUENT_SHARE
    frequent = marked.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("count")).where(F.col("count") > least).orderBy("mark").toPandas()
    rank = np.argsort(np.lexsort((frequent["mark"], frequent["count"])))
    order = spark.sparkContext.broadcast((frequent["mark"].to_numpy().astype(np.int64), rank.astype(np.int64)))
    keys = stage(marked.select("id", "marks", "n").mapInArrow(_keys(order), "id long, key long"))
    ends = keys.withColumn("turn", F.xxhash64("id", "key")).groupBy("key").agg(F.min_by("id", "turn").alias("a"), F.max_by("id", "turn").alias("b")).where("a <> b")
    heads = ends.select("key", F.explode(F.array("a", "b")).alias("head"))
    # the size of what a Python step gives is underestimated, hence the hints against broadcasts
    near = keys.hint("merge").join(heads.hint("merge"), "key").where("id <> head").select("id", "head").distinct()
    joined = connected_components(_verified(near, named), "opening", "head").select(F.col("node").alias("opening"), F.col("component").alias("head"))

    # the rest: pairs under one key that are not connected
    part = joined.select(F.xxhash64("opening").alias("id"), F.xxhash64("head").alias("part"))
    placed = marked.select("id", "n", "cells").hint("merge").join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    member = keys.hint("merge").join(placed.hint("merge"), "id")
    several = member.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("greatest")).where("least <> greatest").select("key")
    member = stage(member.hint("merge").join(several, "key", "left_semi"))
    left, right = (member.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "part", "n", "cells"))) for side in "ab")
    # openings that differ in d shingles differ in at most d parities
    differ = F.bit_count(F.col("cells_a").bitwiseXOR(F.col("cells_b"))) * (1 + SIMILAR) <= (F.col("n_a") + F.col("n_b")) * (1 - SIMILAR) + 1e-9
    apart = left.hint("merge").join(right.hint("merge"), "key").where("part_a < part_b").where(differ).select(F.col("id_a").alias("id"), F.col("id_b").alias("head")).distinct()
    return stage(joined.where("opening <> head").union(_verified(apart, named)))


def _verified(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The openings of pairs of ids that are similar."""
    there = named.select(F.col("id").alias("head"), F.col("opening").alias("_head"))
    texts = pairs.hint("merge").join(named, "id").hint("merge").join(there, "head").select("opening", F.col("_head").alias("head"))
    return stage(texts.mapInArrow(_alike, "opening string, head string"))


def _alike(batches):
    """Pairs whose shingles' similarity is SIMILAR or more."""
    for batch in batches:
        kept = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = set(_shingles(a)), set(_shingles(b))
            common = len(x & y)
            kept.append(common >= SIMILAR * (len(x) + len(y) - common))
        yield batch.filter(pa.array(kept, pa.bool_()))


def refusal_openings(pairs: DataFrame) -> DataFrame:
    """``(opening, refusal)`` of the openings that stand under two or more prompts, alone or with their cluster.

    Openings with a number in them or of fewer than four words are no candidates.  ``pairs`` has opening, prompt, cue, words, particular and shared of each answer.  Openings are grouped first, so a
    template of any number of answers is one row; prompts are counted by sketches that are merged with the clusters.
    """
    sums = [F.count("*").alias("answers"), F.sum(F.col("cue").cast("long")).alias("cues"), *(F.sum(c).alias(c) for c in ("words", "particular", "shared"))]
    templates = stage(
        pairs.where(F.size(F.split("opening", " ")) >= 4).where(~F.contains("opening", F.lit("#"))).groupBy("opening").agg(*sums, F.hll_sketch_agg("prompt", F.lit(10)).alias("prompts"))
        .withColumn("named", F.when(F.contains("opening", F.lit("N")), F.col("answers")).otherwise(0))
        .where((F.col("particular") <= VAGUE * F.col("words")) & (F.col("words") <= LONGEST * F.col("answers")))
    )
    cluster = connected_components(opening_links(templates), "opening", "head").select(F.col("node").alias("opening"), F.col("component").alias("head"))
    member = templates.join(cluster, "opening", "left").withColumn("head", F.coalesce("head", "opening"))
    whole = member.groupBy("head").agg(
        *(F.sum(c).alias(c) for c in ("answers", "cues", "words", "particular", "shared", "named")), F.hll_sketch_estimate(F.hll_union_agg("prompts")).alias("prompts")
    )
    bare = (F.col("particular") <= BARE * F.col("words")) & (F.col("shared") <= SHARED * F.col("words")) & (5 * F.col("named") <= F.col("answers"))
    spoken = (2 * F.col("cues") > F.col("answers")) & (F.col("prompts") >= 2)
    told = whole.where((F.col("prompts") >= 2) & (F.col("words") >= LEAST_WORDS * F.col("answers"))).select("head", ((bare & (F.col("prompts") >= PROMPTS)) | spoken).alias("refusal"))
    return member.join(told, "head").select("opening", "refusal")


def pair_defects(df: DataFrame, key: str, question: str, answers: str) -> DataFrame:
    """``(key, pos_no, defect)``: every defective pair, with one defect each.

    ``pos_no`` is the place in the array ``answers`` from 1, or 0 (with defect ``empty``) if it is null or has
    no entries.  Defects are ``empty``, ``copy``, ``refusal``, ``other_language`` and ``truncated``, the first
    that applies in this order.  Rows with a null key and rows with a null or blank question are left
    out; repeated rows count once.  Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answers).alias("a")).where("key IS NOT NULL")
    kind = StructType(
        [
            rows.schema["key"], StructField("pos_no", IntegerType()), StructField("prompt", LongType()), StructField("defect", StringType()), StructField("opening", StringType()), StructField("second", StringType()),
            StructField("cue", BooleanType()), *(StructField(c, IntegerType()) for c in ("words", "particular", "shared")),
        ]
    )
    pairs = stage(spread(rows).mapInArrow(_pairs, kind))
    sound = pairs.where("defect IS NULL OR defect = 'truncated'").dropDuplicates(["key", "pos_no"])
    measures = ["prompt", "cue", "words", "particular", "shared"]
    both = sound.select("opening", *measures).union(sound.where("second <> ''").select("second", *measures))
    refusals = stage(refusal_openings(both).where("refusal").select("opening"))
    first = refusals.withColumn("_first", F.lit(True))
    joined = pairs.join(first, "opening", "left").join(refusals.select(F.col("opening").alias("second"), F.lit(True).alias("_second")), "second", "left")
    vague = (F.col("particular") <= VAGUE * F.col("words")) & (F.col("words") <= LONGEST)
    refused = (F.coalesce("_first", F.lit(False)) | F.coalesce("_second", F.lit(False))) & vague
    told = joined.withColumn("defect", F.when(F.coalesce("defect", F.lit("")).isin("empty", "copy", "other_language"), F.col("defect")).when(refused, "refusal").otherwise(F.col("defect")))
    return told.where("defect IS NOT NULL").select(F.col("key").alias(key), "pos_no", "defect").distinct()


def p5_found(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    return pair_defects(table(spark, folder, "train_data"), "sample_id", "query", "pos")


def p5_rates(spark, folder: str) -> DataFrame:
    """Defective pairs by source and defect."""
    from corpusloom.session import table

    rows = table(spark, folder, "train_data").select("sample_id", "source").dropDuplicates(["sample_id"])
    return p5_found(spark, folder).join(rows, "sample_id").groupBy("source", "defect").agg(F.count("*").alias("pairs"))
