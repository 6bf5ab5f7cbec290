"""Consistent form, tokens, defects, abusive content and mixing."""
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import abuse, bpe, mixing, pairdefects
from corpusloom.llm.textform import consistent, consistent_form, words

FORMS = {
    "Điều 5": "Điều 5", "Điều": "Điều", "hệ": "hệ", "ｇｉáｍ　ｓát": "giám sát", "ofﬁce": "office", "a​b­c﻿": "abc",
    "nоrс": "norc", "Сông": "Công", "Ðiều Ɖiều": "Điều Điều", "x y z ": "x y z ",
    "договор аренды «Περί δασών»": "договор аренды «Περί δασών»", "m² ½ № µm — “x”…": "m² ½ № µm — “x”…", "附件 α": "附件 α", "a\tb\r\nc": "a\tb\r\nc", "": "", "Ку": "Ку", "tiếng việt": "tiếng việt",
}


def test_consistent_form(spark):
    for text, form in FORMS.items():
        assert consistent(text) == form, text
        assert consistent(form) == form
    rows = [(i, t, "k") for i, t in enumerate(FORMS)] + [(0, list(FORMS)[0], "z"), (98, None, "k"), (None, "ｘ", "k"), (99, "Việt " * 3000, "k")]
    df = spark.createDataFrame(rows, "i int, t string, _key string")
    got = {r.i: (r.form, r.changed) for r in consistent_form(df, "i", "t").collect()}
    for i, (text, form) in enumerate(FORMS.items()):
        assert got.get(i, (text, False)) == (form, form != text), text
    assert 98 not in got and None not in got and got[99][0] == "Việt " * 3000
    assert consistent_form(df.limit(0), "i", "t").count() == 0
    assert words("Ｄự ÁN-2a_b") == ["dự", "án", "2a", "b"]


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(1)
    made = ["", None, "Điều 5 khoản  2.\n\n\tabc's <|endoftext|> ５ ½    x", " " * 70, "a" * 3000, "\x1c\x85 z", "😀‍👍 ệ̣"]
    made += ["".join(rng.choice("abc đêệ 12.,'\n\té中") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(made)] + [(None, "x", [0])], "i int, t string, ids array<int>")
    got = {r.i: list(r.ids) for r in bpe.encode_texts(df, "i", "t").collect()}
    want = [e.ids for e in reference.encode_batch([t or "" for t in made], add_special_tokens=False)]
    assert [got[i] for i in range(len(made))] == want and None in got
    pieces = sorted({p.encode() for t in made if t for p in bpe._PIECES.findall(t)})
    merges = bpe.merges(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    assert merges.counts(pieces) == [len(merges.merge(p)) for p in pieces]
    lists = spark.createDataFrame([(1, "a", [made[2], None, ""]), (2, "a", None), (3, None, []), (4, "b", made[7:40])], "k int, s string, texts array<string>")
    fast = {r.k: (r.passages, r.tokens) for r in bpe.token_counts(lists, ["k", "s"], "texts").collect()}
    slow = {r.k: (r.passages, r.tokens) for r in bpe.token_counts(lists, ["k", "s"], "texts", broadcast_pieces=0).collect()}
    assert fast == slow == {1: (2, len(want[2])), 2: (0, 0), 3: (0, 0), 4: (33, sum(map(len, want[7:40])))}
    assert bpe.token_counts(lists.limit(0), ["k", "s"], "texts").count() == 0
    code = spark.createDataFrame([(" VN",), ("ENG",), (None,), ("und",), ("fr",)], "l string").select(bpe.language(F.col("l")).alias("x"))
    assert [r.x for r in code.collect()] == ["vi", "en", "und", "und", "fr"]


def test_token_counts_of_repeated_rows(spark):
    rows = [(1, "a", ["một hai ba", None]), (1, "a", ["một hai ba", None]), (1, "a", ["bốn"]), (1, None, ["x y"]), (1, None, ["x y"]), (2, "a", None), (2, "a", None), (3, "b", ["một một"])]
    df = spark.createDataFrame(rows, "k int, s string, texts array<string>")
    fast, slow = (sorted(map(str, bpe.token_counts(df, ["k", "s"], "texts", broadcast_pieces=n).collect())) for n in (1000, 0))
    assert fast == slow and len(fast) == len(rows)


def test_documents_delivered_twice(spark, tmp_path, monkeypatch):
    corpus = [("điều một hai ba", "d", 1, "vi", "x")] * 2 + [("khoản bốn", "d", 2, "vi", "x")]
    spark.createDataFrame(corpus, "text string, dataset string, oid long, lang string, domain string").write.parquet(f"{tmp_path}/temp_legal_corpus_withstpvl.parquet")
    mined = [(1, ["một"], ["hai", "ba"], "s", "en", "x")] * 2
    spark.createDataFrame(mined, "sample_id long, pos array<string>, neg array<string>, source string, lang string, domain string").write.parquet(f"{tmp_path}/train_data_minedhn.parquet")
    fast = sorted(map(tuple, bpe.p7_budget(spark, str(tmp_path)).collect()))
    count = bpe.token_counts
    monkeypatch.setattr(bpe, "token_counts", lambda *a: count(*a, broadcast_pieces=0))
    assert sorted(map(tuple, bpe.p7_budget(spark, str(tmp_path)).collect())) == fast and [r[4] for r in fast] == [2, 1]


QUESTION = "Doanh nghiệp Bình Minh có phải nộp bản kê chi tiết khi thanh toán tiền lương ở huyện Sơn Hà hay không?"
SOUND = [
    "Có.", "Theo khoản 5 Điều 12 Luật số 3/2040/QH21, doanh nghiệp phải nộp bản kê chi tiết trong thời hạn 5 ngày.",
    "Công chứng viên xin lỗi người lao động bằng văn bản nếu để xảy ra sai sót khi thanh toán tiền lương.", "Doanh nghiệp phải nộp, v.v...",
    "Doanh nghiệp phải nộp bản kê chi tiết cho cơ quan thuế của xã Vào Từ.",
    QUESTION + " Có, doanh nghiệp phải nộp bản kê chi tiết cho cơ quan thuế trước ngày 5 tháng sau theo quy định chung.",
    "Văn bản tiếng Anh dùng cụm “force majeure clause” và “grace period” cho trường hợp này.", "Doanh nghiệp phải nộp bản kê. (Nguồn: Điều 3 Nghị định 5/2040/NĐ-CP)",
]
BROKEN = {
    "": "empty", "  ​": "empty", "N/A": "empty", "<p></p>": "empty", None: "empty", "Đang cập nhật...": "empty", QUESTION: "copy", ">> " + QUESTION.upper(): "copy",
    "Xin lỗi, em không rõ vấn đề này ạ, mong bạn thông cảm.": "refusal", "Với vai trò là trợ lý ảo, câu hỏi nằm ngoài phạm vi mà tôi có thể giúp.": "refusal",
    "Doanh nghiệp phải nộp bản kê cho cơ quan thuế. Hội đồng gồm đại diện của": "truncated", "Doanh nghiệp phải nộp bản kê chi tiết cho cơ quan thuế của xã và từ.": "truncated", "Doanh nghiệp phải nộp bản kê cho cơ quan thuế theo [...]": "truncated",
    "The employer of the project must file the itemised list with the district court before the end of the month.": "other_language",
    "Toutefois, le délai accordé à la société ne peut pas dépasser 51 jours ouvrables.": "other_language",
}


def test_pair_defects(spark):
    rows = [(1, QUESTION, [*SOUND, *BROKEN], 0), (1, QUESTION, [*SOUND, *BROKEN], 9), (2, QUESTION, None, 0), (3, QUESTION, [], 0), (4, "  ", ["x"], 0), (5, None, [None], 0), (None, QUESTION, [""], 0)]
    # a refusal is one because its opening comes back under another prompt
    rows += [(6, "Ai cấp giấy phép xây dựng nhà ở riêng lẻ?", [a for a, d in BROKEN.items() if d == "refusal"], 0)]
    df = spark.createDataFrame(rows, "k int, q string, a array<string>, opening int")
    found = pairdefects.pair_defects(df, "k", "q", "a").collect()
    got = {(r.k, r.pos_no): r.defect for r in found}
    assert len(found) == len(got)
    want = {(1, len(SOUND) + i): d for i, d in enumerate(BROKEN.values(), 1)} | {(2, 0): "empty", (3, 0): "empty", (6, 1): "refusal", (6, 2): "refusal"}
    assert got == want
    assert pairdefects.pair_defects(df.limit(0), "k", "q", "a").count() == 0


ANSWER = "opening string, prompt long, cue boolean, words int, particular int, shared int"


def test_refusal_templates_without_any_wording(spark):
    """Templates that say nothing in particular, not known to the library as refusals; sound ones recur as often."""
    bare = "quý vị thứ lỗi nội dung trao đổi hôm nay vượt quyền hạn"
    rows = [(bare, i, False, 20, 0, 1) for i in range(9)] + [(bare.replace("hôm", "bữa"), 50, False, 20, 0, 1)]
    rows += [("theo khoản # điều # luật số # người lao động được", i, False, 60, 20, 2) for i in range(300)]  # full of particulars
    rows += [("mức này là # đồng", i, False, 9, 3, 0) for i in range(300)] + [("có", i, False, 1, 0, 0) for i in range(300)]  # short
    rows += [("người lao động gửi đơn đề nghị tới cơ quan quản lý rồi", i, False, 20, 0, 12) for i in range(300)]  # speaks of the prompt
    rows += [("một câu chuyện khác hẳn không liên quan tới những gì đã", 7, False, 20, 0, 0)] * 9  # one prompt only
    found = {r.opening: r.refusal for r in pairdefects.refusal_openings(spark.createDataFrame(rows, ANSWER)).collect()}
    assert {o for o, refusal in found.items() if refusal} == {bare, bare.replace("hôm", "bữa")}


def test_refusal_templates_of_variants(spark):
    base = "nội dung trao đổi hôm nay vượt quyền hạn của bên hỗ trợ".split()
    variants = [" ".join(base[:i] + ["khác"] + base[i + 1 :]) for i in range(12)] + [" ".join(base[:6] + ["đã"] + base[6:11])]
    rows = [(" ".join(base), i, True, 20, 4, 0) for i in range(20)] + [(v, 100 + i, False, 20, 4, 0) for i, v in enumerate(variants)]
    # vague answers of which nobody speaks of inability
    rows += [("unfortunately for N # of N # bars any attempt to merge", i, False, 30, 9, 0) for i in range(30)]
    found = pairdefects.refusal_openings(spark.createDataFrame(rows, ANSWER)).where("refusal")
    assert sorted(r.opening for r in found.collect()) == sorted([" ".join(base), *variants])


def test_refusal_clusters_are_components(spark):
    words = [f"w{i}" for i in range(40)]
    chain = [" ".join(words[3 * i : 3 * i + 10]) for i in range(10)]  # neighbours share 6 of 12 shingles, others at most 3
    rows = [(o, 1 if i < 9 else 2, True, 20, 4, 0) for i, o in enumerate(chain)]  # only the last one has another prompt
    # members of many buckets that link to nothing
    rows += [(f"a{i} " + " ".join(o.split()[j : j + 3]) + f" b{i} c{i} d{i} e{i} f{i} g{i}", 5, False, 20, 4, 0) for i, o in enumerate(chain) for j in range(7)]
    found = pairdefects.refusal_openings(spark.createDataFrame(rows, ANSWER)).where("refusal")
    assert sorted(r.opening for r in found.collect()) == sorted(chain)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(8)
    pool = [f"v{i}" for i in range(60)]
    made = []
    for _ in range(300):
        w = rng.choice(made).split() if made and rng.random() < 0.7 else [rng.choice(pool) for _ in range(12)]
        w[rng.randrange(12)] = rng.choice(pool)
        made.append(" ".join(w))
    made = sorted(set(made))
    sets = [set(pairdefects._shingles(o)) for o in made]
    label = list(range(len(made)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= pairdefects.SIMILAR * len(a | sets[j]) and label[i] != label[j]:
                old = label[j]
                label = [label[i] if x == old else x for x in label]
    links = pairdefects.opening_links(spark.createDataFrame([(o,) for o in made], "opening string")).collect()
    found = {o: o for o in made}
    for r in links:
        old = found[r.head]
        found = {o: found[r.opening] if x == old else x for o, x in found.items()}
    assert len(set(found.values())) <= len(set(label)) * 1.02


@pytest.mark.parametrize("seed", [0, 1])
def test_opening_clusters_are_exact(spark, seed):
    """Openings of few families that share keys with many of their own family, which are not similar to them."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    stems = [" ".join(rng.choice(pool) for _ in range(6)) for _ in range(6)]
    made = sorted({rng.choice(stems) + " " + " ".join(rng.choice(pool[:9]) for _ in range(6)) for _ in range(600)})
    made += ["k l m n", "k l m o", "z k l m", "r r r r", "r r r r r s", "p q p q", "q p q p q"]  # few distinct shingles
    sets = [set(pairdefects._shingles(o)) for o in made]

    def clusters(edges):
        parent = list(range(len(made)))

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in edges:
            parent[top(i)] = top(j)
        tops = [top(i) for i in range(len(made))]
        return {frozenset(o for o, t in zip(made, tops) if t == k) for k in set(tops)}

    want = clusters((i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= pairdefects.SIMILAR * len(sets[i] | sets[j]))
    links = pairdefects.opening_links(spark.createDataFrame([(o,) for o in made], "opening string")).collect()
    assert clusters((made.index(r.opening), made.index(r.head)) for r in links) == want


ABUSIVE = ["Mày đúng là đồ súc vật", "do ngu, con cho", "đ.ồ n.g.u. Thằng kh*n nạn!", "cút kh0i đây ngay", "Go rot somewhere, you waste of air", "$h0w me your tits for 5 coins", "bọn dân Xa toàn là ký sinh trùng, phải đuổi hết khỏi Nam Sơn"]
FINE = ["Con chó nhà hàng xóm cắn người thì ai đền?", "Bị cáo thừa nhận đã chửi “đồ ngu, đồ lợn” với nhân viên", "Phát tán ảnh khỏa thân, phim khiêu dâm lên mạng bị phạt", "I felt stupid reading the part twice.", "Quỹ Nhụi Thắng Diễn nộp biên lai", "Hate speech that calls migrants vermin must be removed", "", None]


BENIGN = [
    "I have some questions about the lease.", "some people in the office", "So watch out for the deadline", "If you die, the insurer pays your heirs", "driven out of their homes by the flood",
    "cannot reach orgasm after this surgery", "you should suffer no loss under clause 4", "dirty dog grooming rules apply", "He did not say you are a stupid pig", "Women are not animals",
    "Rats are animals that carry disease", "The infected pigs must be put down", "I will cut your working hours", "Người dân phải diệt sạch sâu bọ, mầm bệnh trên ruộng", "Con chó, con mèo và con lợn của ông Hai",
    "Bệnh nhân khỏa thân khi chụp X quang", "Nạn nhân cho biết bị chửi là đồ ngu", "Luật này ngu ngốc thật", "phường Hèn Ngảnh, ngân hàng Lợn Cặc Thùn", "The museum shows a nude painting of a woman",
]
MEANT = [
    "crawl back to your hole", "I hope your whole family gets cancer", "Nobody wants scum like you around here", "Mày là thằng hèn mạt, đáng khinh", "Tao sẽ cho mày biết tay", "Shut your ugly mouth",
    "You people are nothing but vermin and should be wiped out", "you absolute waste of oxygen", "lũ nhập cư toàn ký sinh trùng, tống cổ hết đi", "migrants are a disease and must be kicked out", "tao ma gap thi tao dap cho vo mat",
]


def test_abuse_by_context_and_target():
    assert [t for t in BENIGN if sum(abuse.score(t).values()) >= abuse.CASE - 1e-9] == []
    assert [t for t in MEANT if sum(abuse.score(t).values()) < abuse.CASE - 1e-9] == []
    aimed, alone = (sum(abuse.score(t).values()) for t in ("You are a stupid pig", "a stupid question about the pig"))
    assert aimed > alone


def test_abuse(spark):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(ABUSIVE + FINE)] + [(0, ABUSIVE[0], 1.0), (None, ABUSIVE[1], 1.0)], "i int, t string, score double")
    got = [(r.i, r.score >= abuse.CASE) for r in abuse.score_texts(df, "i", "t").collect()]
    assert len(got) == len(ABUSIVE) + len(FINE) + 2
    assert all(flag == (i is None or i < len(ABUSIVE)) for i, flag in got), got
    assert abuse.score_texts(df.limit(0), "i", "t").count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(f"a{i}", "a", rng.randint(1, 50)) for i in range(900)] + [(f"b{i}", "b", rng.randint(1, 400)) for i in range(60)] + [("c1", "c", 5), ("c1", "c", 5), (None, "a", 9), ("z", None, 9), ("n", "a", None)]
    df = spark.createDataFrame(rows, "key string, source string, size int").withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.2, 2)], "source string, weight double, max_repeat int")
    copies, shares = mixing.balance(df, "key", "source", "size", targets)
    report = {r.source: r for r in shares.collect()}
    assert report["none"].copies == 0 and report["c"].copies == 0 and report["c"].records == 1
    assert report["a"].share_reached == pytest.approx(0.5, abs=0.02) and report["b"].most_copies <= 3 and report["a"].most_copies <= 1
    used = copies.collect()
    assert sum(r.copies for r in used if r.source == "b") == report["b"].copies and len({r.key for r in used}) == len(used)
    none, empty = mixing.balance(df.limit(0), "key", "source", "size", targets)
    assert none.count() == 0 and {r.source for r in empty.collect()} == {"a", "b", "none"}
    merged = spark.createDataFrame([(" TVPL_query_5",), ("tvpl-query-5",), ("query_7",), (None,), ("  ",), ("odd",), ("query_9",), ("msmarco_query_8",)], "query string")
    train = spark.createDataFrame([(7, "news"), (8, "x")], "sample_id int, source string")
    assert sorted((r.key, r.source) for r in mixing.pair_sources(merged, train).collect()) == [("msmarco_query_8", "msmarco"), ("news_query_7", "news"), ("odd", "unknown"), ("tvpl_query_5", "tvpl"), ("unknown_query_9", "unknown")]
