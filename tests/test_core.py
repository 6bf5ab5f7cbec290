"""Unit tests of the library by hand values and brute force on small tables."""
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing, text as T
from corpusloom.operators import dedup, etl, html, metrics, models, negatives, retrieval, training
from corpusloom.operators.graph import connected_components
from corpusloom.operators.nested import dewey_tables
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ngrams_and_tokens(spark):
    parts = F.array(*map(F.lit, "abcd"))
    assert one(spark, T.ngrams(parts, 2, 1)) == ["a b", "b c", "c d"]
    assert one(spark, T.ngrams(parts, 2, 5)) == []
    assert one(spark, T.ngrams(F.array(F.lit("a"), F.lit("b")), 3, 1)) == ["a b"]
    assert set(one(spark, T.numbered_words(F.lit("Điều 5 khoản abc")))) == {"Điều 5", "khoản ", "abc"}
    assert one(spark, T.long_enough(F.lit("a,,b,,"), 5)) is True
    assert one(spark, T.normalize_text(F.lit("  A１–B… 2—3\u0007 "))) == "A0-B... 0 - 0"
    assert one(spark, T.strip_leading(F.lit("-. (x) y"))) == "x) y"
    assert one(spark, T.plain_blanks(F.lit("a b​c"))) == "a bc" and one(spark, T.drop_blanks(F.lit("a b​c"))) == "abc"
    assert one(spark, T.parent_id(F.lit("a_b_3"))) == "a_b"
    assert one(spark, T.id_number(F.lit("q_12"))) == 12 and one(spark, T.id_number(F.lit("q"))) is None
    assert one(spark, T.url_id(F.lit("https://x/van-ban-123.aspx"))) == "123"
    assert one(spark, T.strip_accents(F.lit("Điều lệ"))) == "Đieu le"


def test_sentences_and_chunks():
    text = " One. Two?  (Three)\nfour! "
    sentences, fillers = T.split_with_fillers(text)
    assert len(fillers) == len(sentences) + 1
    assert fillers[0] + "".join(s + f for s, f in zip(sentences, fillers[1:])) == text
    assert T.split_with_fillers("   ") == ([], ["   "]) and T.split_with_fillers("") == ([], [""])
    long = "word " * 500
    pieces = T.chunk_text(long, 50, 10)
    assert all(len(p) <= 50 for p in pieces) and T.chunk_text("", 50, 10) == []
    assert sorted(i for b in models.translation_batches([3, 200, 150, 5]) for i in b) == [0, 1, 2, 3]


def test_hashes(spark):
    assert one(spark, hashing.sha1_number(F.lit("hello world"))) == 896314922
    assert one(spark, hashing.xxh3_number(16)(F.lit("hello world"))) == 39051
    assert one(spark, hashing.xxh3_number(32)(F.lit("hello world"))) == 1088854155
    assert hashing.optimal_bands(0.75, 256) == (21, 12)
    assert hashing.optimal_bands(0.75, 256, 0.1, 0.9) == (28, 9)
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, None)], "k int, g array<string>")
    rows = {(r.k, r.band): r.sig for r in hashing.band_signatures(df, "k", F.col("g"), 5, 4, 20).collect()}
    assert all(rows[1, b] == rows[2, b] and rows[3, b] == rows[4, b] for b in range(5))
    want = ",".join(map(str, hashing.signature({"a", "b"}, 20)[:4]))
    assert rows[1, 0] == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (None, 1), (3, 2), *((100, i) for i in range(101, 160))]
    found = dict(connected_components(spark.createDataFrame(edges, "src int, dst int")).collect())
    assert found[3] == found[2] == found[1] == 1 and found[5] == 4 and found[6] == 6 and 7 not in found
    assert {found[i] for i in range(100, 160)} == {100}
    chain = dict(connected_components(spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")).collect())
    assert set(chain.values()) == {0}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_dewey_tables(spark):
    schema = "item_id int, label string, qa array<struct<question:string,rel:array<struct<title:string>>>>"
    rows = [
        (1, "x", [{"question": "a", "rel": [{"title": "t"}, None, {"title": None}]}, None, {"question": None, "rel": None}]),
        (1, "x", [{"question": "a", "rel": [{"title": "t"}, None, {"title": None}]}, None, {"question": None, "rel": None}]),
        (2, "x", []), (3, "x", None), (None, "x", [{"question": "z", "rel": []}]),
    ]
    df = spark.createDataFrame(rows, schema)
    found = dewey_tables(df, "item_id", "qa")
    assert {(r.item_id, tuple(r.label), tuple(r.parent), r.question) for r in found["qa"].collect()} == {(1, (1,), (), "a"), (1, (3,), (), None)}
    assert {(r.item_id, tuple(r.label), tuple(r.parent), r.title) for r in found["qa.rel"].collect()} == {(1, (1, 1), (1,), "t"), (1, (1, 3), (1,), None)}
    assert sorted(map(tuple, found[""].collect())) == [(1, "x"), (2, "x"), (3, "x")] and found[""].columns == ["item_id", "label"]
    assert sorted(map(tuple, dewey_tables(df.select("item_id", "qa"), "item_id", "qa")[""].collect())) == [(1,), (2,), (3,)]
    whole = dewey_tables(df, "item_id", "qa", childless=True)["qa.rel"]
    assert {(r.item_id, *r.label) for r in whole.collect()} == {(1, 1, 1), (1, 1, 3), (1, 3, 0), (2, 0, 0), (3, 0, 0)}
    assert dewey_tables(df.limit(0), "item_id", "qa")["qa.rel"].count() == 0


def test_dedup_and_representatives(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "x"), (4, "b", "y")], "k int, t string, s string")
    assert sorted(r.k for r in dedup.exact_dedup(df, ["t", "s"], "k").collect()) == [1, 2, 4]
    rows = spark.createDataFrame([(1, "long text", 9, "x"), (2, "tiny", 9, "sft_a"), (3, "same", 9, "sft_b"), (4, None, 8, "x")], "k int, t string, c int, s string")
    best = dict(dedup.representatives(rows, "k", "t", "c", F.col("s").startswith("sft")).select("c", "k").collect())
    assert best == {9: 2, 8: 4}
    arrays = spark.createDataFrame([(1, [5, 6, 5]), (2, [])], "r int, a array<int>")
    mapped = dedup.remap_array(arrays, "r", "a", spark.createDataFrame([(5, 50)], "k int, v int"), "k", "v")
    assert {r.r: r.a for r in mapped.collect()} == {1: [50, 6, 50], 2: []}
    split = spark.createDataFrame(list(zip(range(6), [1, 1, 2, 2, 2, 3])), "i int, c int")
    got = {r.i: r.split for r in dedup.leak_free_split(split, "c", "i", 2).collect()}
    assert [got[i] for i in range(6)] == ["train", "train", "test", "test", "test", "test"]
    assert one(spark, dedup.jaccard(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd")))) == 0.5
    assert one(spark, dedup.containment(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd")))) == pytest.approx(2 / 3)


def test_near_dedup_modes(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(base), " ".join(f"z{i}" for i in range(60)), "too short", None, "a b c . ."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    clusters = dedup.lsh_clusters(df, "k", "t", 0.5)
    got = dict(clusters.collect())
    assert got[0] == got[1] == got[2] == 0 and got[3] == 3 and 4 not in got and 5 not in got
    for mode in ("centroid", "previous", "full"):
        labels = dict(dedup.VERIFY[mode](df, "k", "t", clusters, 0.7).select("k", "cluster").collect())
        assert labels[0] == labels[1] == labels[2] == 0 and labels[3] == 3, mode
    named = dedup.near_dedup(df.withColumn("__cluster__", F.lit(1)), "k", "t", 0.5)
    assert "__cluster__1" in named.columns
    same = clusters.withColumn("cluster", F.lit(0))
    assert dict(dedup.verify_previous(df, "k", "t", same, 0.7).select("k", "cluster").collect())[2] == 0


@pytest.mark.parametrize("threshold", [0.3, 0.52, 0.8])
def test_verification_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(90):
        w = list(rows[rng.randrange(i)][1].split()) if i and rng.random() < 0.6 else [rng.choice(pool) for _ in range(12)]
        if w and rng.random() < 0.8:
            w[rng.randrange(len(w))] = rng.choice(pool)
        rows.append((i, " ".join(w)))
    rows.append((90, ""))
    df = spark.createDataFrame(rows, "k int, t string")
    clusters = spark.createDataFrame([(i, i % 2) for i, _ in rows], "k int, cluster int")
    sets = {r.k: set(r.w) for r in df.select("k", T.numbered_words(F.col("t")).alias("w")).collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) > 0 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold
    previous, full = {}, {i: i for i in sets}
    for i in sets:
        previous[i] = next((previous[j] for j in range(i) if j % 2 == i % 2 and alike(i, j)), i)
        for j in range(i):
            if j % 2 == i % 2 and alike(i, j) and full[i] != full[j]:
                a, b = sorted((full[i], full[j]))
                full = {k: a if v == b else v for k, v in full.items()}
    assert dict(dedup.verify_previous(df, "k", "t", clusters, threshold).select("k", "cluster").collect()) == previous
    assert dict(dedup.verify_full(df, "k", "t", clusters, threshold).select("k", "cluster").collect()) == full


def test_knn_matches_brute_force(spark):
    rng = np.random.RandomState(1)
    vectors = rng.randn(60, 5).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(60, None)]
    df = spark.createDataFrame(rows, "i int, e array<float>")
    found = retrieval.knn_join(df.where("i < 6"), df, 4, "i", "i", "e", skip_self=True, block_numbers=10)
    got = {(r.qid, r["rank"]): (r.pid, r.score) for r in found.collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for q in range(6):
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-round(float(unit[q] @ unit[j]), 12), j))[:4]
        assert [got[q, r][0] for r in range(1, 5)] == order
    assert retrieval.knn_join(df.limit(0), df, 3, "i", "i", "e").count() == 0


def test_bm25_matches_brute_force(spark):
    docs = {0: "a b b c", 1: "a a d", 2: "", 3: "e f a"}
    df = spark.createDataFrame(list(docs.items()), "d int, text string")
    asked = spark.createDataFrame([("q", "b a a zz")], "q string, text string")
    terms = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    got = {r.pid: r.score for r in retrieval.bm25(asked, "q", terms(F.col("text")), df, "d", terms(F.col("text"))).collect()}
    split = {k: v.split() for k, v in docs.items()}
    mean = sum(map(len, split.values())) / 4
    for d, words in split.items():
        if not set(words) & {"a", "b"}:
            assert d not in got
            continue
        score = 0.0
        for t in ["b", "a", "a"]:
            df_t = sum(t in w for w in split.values())
            tf = words.count(t)
            score += math.log(5 / df_t) * (1 + tf * 1.6 / (0.6 * (1 - 0.9 + 0.9 * len(words) / mean) + tf))
        assert got[d] == pytest.approx(score)


def test_fusion_collapse_rerank(spark):
    a = spark.createDataFrame([("q", "p", 1), ("q", "r", 2)], "qid string, pid string, rank int")
    b = spark.createDataFrame([("q", "p", 3)], "qid string, pid string, rank int")
    got = {r.pid: r.score for r in retrieval.rrf(a, b, 10, 0.1).collect()}
    assert got["p"] == pytest.approx(0.9 / 11 + 0.1 / 13) and got["r"] == pytest.approx(0.9 / 12)
    chunks = spark.createDataFrame([("q", "A_0", 1), ("q", "B_1", 2), ("q", "A_3", 3)], "qid string, pid string, rank int")
    assert [r.pid for r in retrieval.collapse_chunks(chunks).orderBy("rank").collect()] == ["A", "B", "already_exist"]
    scores = spark.createDataFrame([("q", "r", 5.0), ("q", "p", 1.0)], "qid string, pid string, score double")
    assert [r.pid for r in retrieval.rerank(a, scores).orderBy("rank").collect()] == ["r", "p"]
    pairs = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "q array<array<float>>, p array<array<float>>")
    assert retrieval.max_sim(pairs, "q", "p").first().score == 0.5
    corpus = models.encode(spark.createDataFrame([("1", "red fox"), ("2", "blue sky"), ("3", None)], "pid string, text string"), "pid", "text", models.hashed_encoder(64))
    texts = corpus.join(spark.createDataFrame([("1", "red fox"), ("2", "blue sky")], "pid string, text string"), "pid")
    assert retrieval.search("blue sky", texts, models.hashed_encoder(64), scorer=models.overlap_scorer, top=1).first().pid == "2"


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([("q", "d3", 1), ("q", "d1", 2), ("q", "d2", 3)], "qid string, pid string, rank int")
    qrels = spark.createDataFrame([("q", "d1"), ("q", "d2"), ("r", "d9")], "qid string, pid string")
    found = {(r.metric, r.k): r.value for r in metrics.evaluate(results, qrels, None, (1, 3), (3,)).collect()}
    assert found["accuracy", 1] == 0 and found["accuracy", 3] == 1 and found["recall", 3] == 1
    assert found["precision", 3] == pytest.approx(2 / 3) and found["mrr", 3] == 0.5
    assert found["ndcg", 3] == pytest.approx(0.693426, abs=1e-6) and found["map", 3] == pytest.approx(0.583333, abs=1e-6)
    asked = spark.createDataFrame([("q",), ("r",)], "qid string")
    assert {(r.metric, r.k): r.value for r in metrics.evaluate(results, qrels, asked, (3,), (3,)).collect()}["mrr", 3] == 0.25
    assert metrics.formatted(metrics.evaluate(results, qrels, None, (3,), ())).where("name = 'precision@3'").first().text == "66.67%"


def test_negatives(spark):
    scored = spark.createDataFrame(
        [("q", [("a", 9.0), ("b", 7.0)], {"s1": [("p1", 3.0), ("p2", 5.0), ("p3", 2.0)], "s2": [("p1", 3.0), ("p4", 1.0)]})],
        "qid string, pos array<struct<pid:string,ce_score:double>>, neg map<string,array<struct<pid:string,ce_score:double>>>",
    )
    limited = scored
    got = negatives.margin_negatives(limited, 3.0, 2).first()
    assert got.pos == ["a", "b"] and got.neg == ["p1", "p3", "p4"]
    near = spark.createDataFrame([("q", str(i), i) for i in range(1, 30)], "qid string, pid string, rank int")
    positives = spark.createDataFrame([("q", 5), ("q", 6)], "qid string, pid int")
    mined = negatives.mine_negatives(near, positives, 2, 20, 10)
    ids = {int(r.pid) for r in mined.collect()}
    assert len(ids) == 10 and not ids & {1, 2, 5, 6} and max(ids) <= 20
    clusters = spark.createDataFrame([(str(i), i % 2) for i in range(1, 30)], "pid string, cluster int")
    own = spark.createDataFrame([("q", "0")], "qid string, cluster string")
    assert all(int(r.pid) % 2 for r in negatives.mine_negatives(near, positives, 2, 20, 10, clusters=clusters, query_clusters=own).collect())


def test_training(spark):
    df = spark.createDataFrame([(i, "x" if i < 90 else "y", list("ab"), list("cd")) for i in range(101)], "k int, f string, pos array<string>, neg array<string>")
    plan = training.epoch_plan(df, "f", "k", F.lit(10), processes=2, seed=3).collect()
    assert len({(r.batch, r.place) for r in plan}) == len(plan)
    sizes = {}
    for r in plan:
        sizes.setdefault(r.batch, []).append(r)
    assert all(len({r.f for r in rows}) == 1 and len(rows) == rows[0].batch_rows <= 20 for rows in sizes.values())
    assert sum(map(len, sizes.values())) == 101
    again = training.epoch_plan(df, "f", "k", F.lit(10), processes=2, seed=3).collect()
    assert sorted(map(tuple, ((r.k, r.batch, r.place) for r in plan))) == sorted((r.k, r.batch, r.place) for r in again)
    group = training.sampled_group(df, "k", 6, 1).first()
    assert len(group.passages) == 6 and group.passages[0] in "ab" and set(group.passages[1:]) <= set("cd") and group.labels == [1, 0, 0, 0, 0, 0]
    empty = spark.createDataFrame([(1, None, None), (2, ["p"], None)], "k int, pos array<string>, neg array<string>")
    assert {r.k: r.passages for r in training.sampled_group(empty, "k", 3, 1).collect()} == {1: None, 2: ["p"]}
    buckets = [one(spark, training.length_bucket(F.lit(n), [0, 512, 1024])) for n in (0, 511, 512, 1024)]
    assert buckets == ["0-512", "0-512", "512-1024", "1024-inf"]
    assert training.cap_rows(df, "f", "k", 7, 5).groupBy("f").count().where("count <> 7").count() == 0


def test_etl(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(200)], "v double, i int")
    pos = [r.pos for r in etl.row_index(df, ["v"]).orderBy("v").collect()]
    assert pos == list(range(200))
    assert etl.row_index(df.limit(0), ["v"]).count() == 0
    ids = dict(etl.dense_ids(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "t string, n int"), "t", "n", "doc_", "id").collect())
    assert ids == {"b": "doc_0", "a": "doc_1"}
    kept = etl.keep_in(spark.createDataFrame([(1, ["a", "b"], [7, 8]), (2, [], [])], "r int, i array<string>, l array<int>"), "r", "i", "l", spark.createDataFrame([(8,)], "c int"), "c")
    assert {r.r: (r.i, r.l) for r in kept.collect()} == {1: (["b"], [8]), 2: ([], [])}
    squad = spark.createDataFrame(
        [([{"title": "t", "paragraphs": [{"context": "c1", "qas": [{"question": "q1", "is_impossible": False}, {"question": "q2", "is_impossible": True}]}, {"context": "c2", "qas": [{"question": "q3", "is_impossible": None}]}]}],)],
        "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<question:string,is_impossible:boolean>>>>>>",
    )
    assert [(r.doc_id, r.qid, r.question) for r in etl.flatten_squad(squad).orderBy("qid").collect()] == [("doc_0", "query_0", "q1"), ("doc_1", "query_1", "q3")]
    found = etl.texts_of_ids(spark.createDataFrame([(1, ["y", "x", "n"])], "r int, a array<string>"), "r", "a", spark.createDataFrame([("x", "tx"), ("y", "ty")], "id string, text string"), "id", "text", "out")
    assert found.first().out == ["ty", "tx"]


PAGE = """<html><body><h2>First?</h2><p>see <a href="/a">A</a></p><script>var x = "</p><h2>no</h2>"</script>
<p><a href="/b">B</a><h2>Second?</h2><p>none</p></body></html>"""
LAW = """<h1>Law 1</h1><table><tr><td>No</td><td>1/2020</td><td></td><td></td><td>Office</td></tr><tr><td>Kind</td><td>Decree</td></tr></table>
<span class="status">Valid</span><p><a name="chuong_1">Chapter <strong><span>I</span></strong></a></p><p>Line
two</p>"""


def test_sentence_fillers_and_batch_tables(spark):
    text = "One  two. Three...  four."
    sentences, fillers = T.split_with_fillers(text, collapsed=True)
    assert "".join(f + s for f, s in zip(fillers, [*sentences, ""])) == "One two. Three. four."
    assert T.align_fillers("a b. c", ["b.", "c"]) == ["a ", " ", ""] and T.align_fillers("abc", ["x"], ignore_errors=True) == ["a", "c"]
    with pytest.raises(ValueError):
        T.align_fillers("abc", ["x"])
    assert one(spark, training.group_batch_rows(F.lit("0-512"), 1, 5)) == 144 and one(spark, training.group_batch_rows(F.lit("0-512"), 3, 5, True)) == 60
    assert one(spark, training.group_batch_rows(F.lit("0-512"), 7, 5)) == 5 and one(spark, training.group_batch_rows(F.lit("x"), 2, 5)) == 5


def test_missing_folder_and_languages(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        readers.read_folder(spark, str(tmp_path / "none"))
    names = spark.createDataFrame([("queries_en.json.gz",), ("queries.json",), (None,), ("a_vi",)], "f string").select(etl.file_language(F.col("f")).alias("l"))
    assert [r.l for r in names.collect()] == ["en", "vi", "vi", "vi"]


def test_stored_index_scores_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, ""), (4, None)], "k long, t string")
    asked = spark.createDataFrame([("q", "b c"), (None, "b")], "q string, t string")
    terms = F.split("t", " ")
    direct = {(r.pid, round(r.score, 9)) for r in retrieval.bm25(asked, "q", terms, docs, "k", terms).collect()}
    retrieval.build_bm25(docs, "k", terms, str(tmp_path / "index"))
    stored = retrieval.search_bm25(retrieval.load_bm25(spark, str(tmp_path / "index")), asked, "q", terms)
    assert {(r.pid, round(r.score, 9)) for r in stored.collect()} == direct and {p for p, _ in direct} == {1, 2}
    texts = spark.createDataFrame([(1, "một hai"), (2, "hai ba"), (3, ""), (4, None)], "k long, t string")
    encoded = models.encode_all(texts, "k", "t", models.hashed_multi_encoder(8))
    side = lambda k, p: encoded.select(F.col("k").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in ("dense", "lexical", "vectors")))
    scores = {(r.qid, r.pid): r for r in retrieval.pair_scores(side("qid", "q").crossJoin(side("pid", "p"))).collect()}
    assert scores[1, 1].dense == pytest.approx(1, abs=1e-6) and scores[1, 1].colbert == pytest.approx(1, abs=1e-6) and scores[1, 2].sparse > 0 and scores[3, 4].sparse == 0
    weights = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.9), (1, 99, 1.0)], "k int, token_id int, weight double")
    named = models.token_strings(weights, spark.createDataFrame([(7, "x"), (8, "x")], "token_id int, token string")).collect()
    assert [(r.k, r.token, r.weight) for r in named] == [(1, "x", 0.9)]
    text = metrics.report(spark.createDataFrame([("recall", 5, 0.25), ("map", 5, 0.5)], "metric string, k int, value double"), "Law")
    assert text == "Law\nmap@5: 0.5000\nrecall@5: 25.00%"


def test_nearest_neighbours_with_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, embedding array<double>").repartition(5)
    found = retrieval.knn_join(df.where("k < 3"), df, 7, "k", "k", skip_self=True).collect()
    for q in range(3):
        want = sorted((i for i in range(40) if i != q), key=lambda i: (-(1.0 if bool(i % 3) == bool(q % 3) else 0.0), i))[:7]
        assert [r.pid for r in sorted(found, key=lambda r: r.rank) if r.qid == q] == want
    assert retrieval.knn_join(df.limit(0), df, 7, "k", "k").count() == 0 and retrieval.knn_join(df, df.limit(0), 7, "k", "k").count() == 0


def test_html(spark):
    pairs = html.qa_pairs(PAGE)
    assert [p["question"] for p in pairs] == ["First?", "Second?"] and [d["href"] for d in pairs[0]["rel_docs"]] == ["/a", "/b"] and pairs[1]["rel_docs"] == []
    nested = "<h2>A</h2><p><a href='/1?x=2&mode=print'>one</a></p><h2>B</h2><p><a href='/2'>two</a> <a href='/3'>three</a></p><p><a href='/4'>four</a></p>"
    assert [[d["href"] for d in p["rel_docs"]] for p in html.qa_pairs(nested)] == [["/1?x=2"], ["/2", "/3", "/4"]]
    law = html.law_page("https://x/law-77.aspx", LAW)
    assert law["id"] == "77" and law["so_hieu"] == "1/2020" and law["noi_ban_hanh"] == "Office" and law["loai_van_ban"] == "Decree" and law["content"] == ["Chapter I", "Line two"]
    assert html.law_page("u", "<p>x</p>") is None
    pages = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    assert {r.url: len(r.qa_pairs) for r in html.extract_qa(pages).collect()} == {"u": 2, "v": 0}
    assert [r.href for r in html.page_links(pages).orderBy("at").collect()] == ["/a", "/b"]
    assert html.extract_laws(spark.createDataFrame([("https://x/law-77.aspx", LAW), ("v", None)], "url string, html string")).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"b": "two", "a": "một"}), encoding="utf8")
    assert [(r.pos, r.id, r.text) for r in readers.read_id_text(spark, str(tmp_path / "map.json")).collect()] == [(0, "b", "two"), (1, "a", "một")]
    (tmp_path / "x.jsonl").write_text('{"query":"q","pos":["p"],"neg":[]}\n')
    assert readers.read_samples(spark, str(tmp_path / "x.jsonl")).columns == ["query", "pos", "neg"]
    (tmp_path / "q.tsv").write_text('1\t0\t "p" \t1\n')
    assert readers.read_qrels_tsv(spark, str(tmp_path / "q.tsv")).collect() == [("1", '"p"')]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float16).reshape(3, 2))
    assert {r.pos: list(r.embedding) for r in readers.read_npy(spark, str(tmp_path / "m.npy")).collect()} == {0: [0, 1], 1: [2, 3], 2: [4, 5]}
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as sink, pa.ipc.new_file(sink, pa.schema([("a", pa.int64())])) as writer:
        writer.write_table(pa.table({"a": [1, 2]}))
    assert sorted(r.a for r in readers.read_arrow(spark, str(tmp_path / "*.arrow"), "a long").collect()) == [1, 2]
    (tmp_path / "d.json").write_text(json.dumps({"items": [{"a": 1}, {"a": 2}]}))
    kind = spark.createDataFrame([], "a int").schema
    assert readers.read_json_items(spark, str(tmp_path / "d.json"), kind, "items").count() == 2
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, bucket string")
    out = str(tmp_path / "buckets")
    sinks.write_buckets(df, out)
    sinks.write_buckets(df.withColumn("k", F.col("k") + 10).union(spark.createDataFrame([(5, "z")], "k int, bucket string")), out)
    assert sorted(r.k for r in spark.read.json(out).collect()) == [1, 2, 5]
    steps = str(tmp_path / "steps")
    sinks.write_in_steps(df, steps, "k", lambda d: d, 3)
    assert spark.read.parquet(steps).count() == 2 and sinks.remaining(df, steps, "k").count() == 0
    sinks.write_id_text(spark.createDataFrame([("a", "1")], "id string, text string"), str(tmp_path / "ids"))
    assert spark.read.text(str(tmp_path / "ids")).first().value == '{"a":"1"}'
    sinks.append_log(df, str(tmp_path / "log"), name="run")
    sinks.append_scores(df, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_models(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None)], "k int, t string")
    found = dict(models.unigram_perplexity(df, "k", "t").collect())
    whole = 3 + 2 + 2 + 1
    assert found[1] == pytest.approx((((3 / whole) ** 2) * (2 / whole) * (3 / whole)) ** (-1 / 4)) and 3 not in found
    done = dict(models.translate(df, "k", "t", lambda s, n: [x.upper() for x in s]).collect())
    assert done == {1: "A A B", 2: "", 3: None}
    scored = models.score_pairs(spark.createDataFrame([("a b", "b c")], "q string, p string"), "q", "p", normalize=True).first().score
    assert scored == pytest.approx(0.5)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("2025-01-01 00:00:00", "a"), ("2025-01-01 00:01:00", "a"), ("2025-01-01 00:02:00", "b")], "at string, text string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    run = incremental.first_seen(stream, "text", "at").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.text for r in spark.table("seen").collect()) == ["a", "b"]


def test_registry_names():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert "dense_metrics" in names and set(sql) <= set(names) and "p6_found" in names




def shuffled(spark):
    """Bytes of shuffle files that the session has written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_similar_in_law_sends_no_words_for_unlike_pairs(spark, tmp_path):
    from corpusloom.operators import library_queries

    rng, names = random.Random(5), [f"word{i:03}" for i in range(160)]
    texts = [" ".join(f"{w}," for w in rng.sample(names, 60)) for _ in range(600)]
    texts[7] = texts[3].replace(texts[3].split()[0], "other,")
    rows = [(i, t, "law") for i, t in enumerate(texts)] + [(3, texts[0], "another law"), (600, texts[3], "law"), (None, texts[3], "law"), (601, texts[3], None), (602, " .", "law"), (603, " .", "law")]
    spark.createDataFrame(rows, "doc_id long, text string, law_id string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    found = sorted(map(tuple, library_queries.similar_in_law(spark, str(tmp_path)).collect()))
    assert shuffled(spark) - before < 4 * sum(map(len, texts))  # not the words of 180,000 pairs
    near = (round(59 / 61, 6), round(59 / 60, 6))
    assert found == [(3, 7, *near), (3, 600, 1.0, 1.0), (7, 600, *near)]


@pytest.mark.parametrize("threshold", [0.6, 0.35])
def test_resembling_pairs_equal_all_pairs(spark, monkeypatch, threshold):
    from corpusloom.operators import setpairs

    monkeypatch.setattr(setpairs, "BLOCK", 16)  # many blocks, also growing ones
    monkeypatch.setattr(setpairs, "LARGEST", 40)
    monkeypatch.setattr(setpairs, "BLOCKS", 3)
    rng, rows = random.Random(6), []
    for law, size in (("a", 260), ("b", 40), ("c", 1), ("d", 15)):
        for _ in range(size):
            if rows and rng.random() < 0.6:  # an edited form of an earlier one
                words = [w for w in rng.choice(rows)[2] if rng.random() < rng.choice((0.7, 0.9, 1))]
                words += [f"n{rng.randrange(999)}" for _ in range(int(len(words) * rng.choice((0, 0.1, 0.3))))]
            else:
                words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((0, 1, 2, 5, 40, 64, 65, 130, 400)))]
            rng.shuffle(words)
            rows.append((rng.randrange(300), law, list(dict.fromkeys(words))))  # keys repeat
    want = []
    for a, law, x in rows:
        for b, other, y in rows:
            c = len({*x} & {*y})
            if law == other and a < b and c and c / (len(x) + len(y) - c) > threshold:
                want.append((a, b, c / (len(x) + len(y) - c), c / min(len(x), len(y))))
    df = spark.createDataFrame(rows, "k long, law string, words array<string>")
    found = setpairs.resembling_pairs(df, "k", "law", F.col("words"), threshold)
    assert len(want) > 300 and sorted(map(tuple, found.collect())) == sorted(want)
