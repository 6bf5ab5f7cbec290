"""Queries over the test tables by name, each with equivalent SQL where SQL can state it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import hashing, text as T
from corpusloom.operators import dedup, etl, metrics, models, negatives, retrieval, training
from corpusloom.plans.staging import stage
from corpusloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _documents(spark, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL")


# SQL fragments
_PARTS = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]')"
_WORDS = f"list_filter({_PARTS}, lambda t: t <> '')"
_DOCS = "documents WHERE text IS NOT NULL"


# -- filters, projections and text functions -----------------------------------------------------


@query(
    f"""SELECT source, count(*) AS docs, sum(len({_WORDS}))::BIGINT AS words, sum(CASE WHEN len({_PARTS}) >= 5 THEN 1 ELSE 0 END)::BIGINT AS long_enough
    FROM {_DOCS} GROUP BY source"""
)
def token_stats(spark, folder):
    rows = _documents(spark, folder)
    words = F.size(F.filter(T.tokens(F.col("text")), lambda t: t != ""))
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(words).alias("words"), F.sum(T.long_enough(F.col("text")).cast("long")).alias("long_enough"))


def _normalized_sql() -> str:
    column = r"regexp_replace(text, '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"
    column = rf"regexp_replace({column}, '\p{{Nd}}', '0', 'g')"
    single = {k: v for k, v in T.PUNCTUATION.items() if len(v) == 1}
    column = f"translate({column}, '{''.join(single)}', '{''.join(single.values()).replace(chr(39), chr(39) * 2)}')"
    for mark, plain in T.PUNCTUATION.items():
        if len(plain) > 1:
            column = f"replace({column}, '{mark}', '{plain}')"
    return rf"SELECT doc_id, regexp_replace({column}, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g') AS normalized FROM {_DOCS}"


@query(_normalized_sql())
def normalized_text(spark, folder):
    return _documents(spark, folder).select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(
    rf"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([\p{{L}}\p{{N}}_]+ *\p{{Nd}}*)', 1))) AS numbered_words,
    regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\.+', '.', 'g') AS collapsed FROM {_DOCS}"""
)
def verify_tokens(spark, folder):
    return _documents(spark, folder).select("doc_id", F.size(T.numbered_words(F.col("text"))).alias("numbered_words"), T.collapse(F.col("text")).alias("collapsed"))


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM {_DOCS}),
    s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w)
    SELECT doc_id, len(s) AS shingles, list_aggregate(list_transform(s, lambda x: md5(x)), 'min') AS least FROM s"""
)
def shingle_stats(spark, folder):
    s = T.shingles(F.col("text"))
    return _documents(spark, folder).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("shingles"), F.array_min(F.transform("s", lambda x: F.md5(x))).alias("least"))


@query(
    """SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
    AND CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END < 16384"""
)
def complete_documents(spark, folder):
    return etl.complete_rows(table(spark, folder, "documents"), ["text", "lang", "source"], "text").select("doc_id")


_BUCKET = """CASE WHEN n >= 512 THEN '512-inf' WHEN n >= 256 THEN '256-512' WHEN n >= 128 THEN '128-256' WHEN n >= 64 THEN '64-128' WHEN n >= 0 THEN '0-64' END"""


@query(
    f"""WITH t AS (SELECT len({_WORDS}) AS n FROM {_DOCS})
    SELECT {_BUCKET} AS bucket, count(*) AS rows, round(avg(n), 6) AS avg_length, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS percent FROM t GROUP BY 1"""
)
def length_buckets(spark, folder):
    rows = _documents(spark, folder).select(F.size(F.filter(T.tokens(F.col("text")), lambda t: t != "")).alias("n"))
    rows = rows.withColumn("bucket", training.length_bucket(F.col("n"), [0, 64, 128, 256, 512]))
    whole = rows.agg(F.count("*").alias("_all"))
    summary = training.bucket_summary(rows, "bucket", "n").crossJoin(F.broadcast(whole))
    return summary.select("bucket", "rows", F.round("avg_length", 6).alias("avg_length"), F.round(100.0 * F.col("rows") / F.col("_all"), 6).alias("percent"))


@query(
    """WITH t AS (SELECT DISTINCT ON (sample_id) sample_id, query, pos, neg FROM train_data),
    l AS (SELECT sample_id, list_max(list_transform(list_concat([query], coalesce(pos, []), coalesce(neg, [])), lambda t: coalesce(length(t), 0))) AS n FROM t)
    SELECT sample_id, n AS longest, CASE WHEN n >= 7000 THEN '7000-inf' WHEN n >= 2000 THEN '2000-7000' WHEN n >= 500 THEN '500-2000' WHEN n >= 0 THEN '0-500' END AS bucket FROM l"""
)
def sample_lengths(spark, folder):
    rows = table(spark, folder, "train_data").dropDuplicates(["sample_id"])
    none = F.array().cast("array<string>")
    longest = training.longest_text([F.array("query"), F.coalesce("pos", none), F.coalesce("neg", none)], lambda t: F.length(t))
    rows = rows.select("sample_id", longest.alias("longest"))
    return rows.withColumn("bucket", training.length_bucket(F.col("longest"), [0, 500, 2000, 7000]))


@query(
    """SELECT item_id, split_part(url, '&mode', 1) AS url, split_part(list_last(string_split(url, '-')), '.', 1) AS page,
    url LIKE 'https:%' AS absolute FROM (SELECT DISTINCT item_id, url FROM qa_items)"""
)
def page_ids(spark, folder):
    rows = table(spark, folder, "qa_items").select("item_id", "url").distinct()
    return rows.select("item_id", T.clean_url(F.col("url")).alias("url"), T.url_id(F.col("url")).alias("page"), F.col("url").startswith("https:").alias("absolute"))


# -- exact duplicates, groups and ids --------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source")
def exact_dedup(spark, folder):
    return dedup.exact_dedup(table(spark, folder, "documents"), ["text", "lang", "source"], "doc_id").select("doc_id")


@query(f"SELECT copies, count(*) AS texts FROM (SELECT count(*) AS copies FROM {_DOCS} GROUP BY text) GROUP BY copies")
def duplicate_histogram(spark, folder):
    return _documents(spark, folder).groupBy("text").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("texts"))


def _text_clusters(spark, folder) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", "text", "source")
    return rows.join(rows.groupBy("text").agg(F.min("doc_id").alias("cluster")), "text")


_CLUSTERED = f"c AS (SELECT doc_id, text, source, min(doc_id) OVER (PARTITION BY text) AS cluster FROM {_DOCS})"


@query(f"WITH {_CLUSTERED} SELECT cluster, array_to_string(list_sort(list(doc_id)), ',') AS members, count(*) AS size FROM c GROUP BY cluster")
def cluster_members(spark, folder):
    found = dedup.cluster_members(_text_clusters(spark, folder), "doc_id", "cluster")
    return found.select("cluster", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "size")


_PREFERRED = "source LIKE 'sft%' OR source = 'zalo_legal_corpus'"


@query(
    f"""WITH l AS (SELECT doc_id, text, source, law_id FROM {_DOCS} AND law_id IS NOT NULL)
    SELECT law_id, doc_id FROM (SELECT law_id, doc_id, row_number() OVER (PARTITION BY law_id ORDER BY coalesce(({_PREFERRED})::INT, -1) DESC, length(text) DESC, doc_id) AS r FROM l) WHERE r = 1"""
)
def law_representatives(spark, folder):
    rows = _documents(spark, folder).where("law_id IS NOT NULL")
    return dedup.representatives(rows, "doc_id", "text", "law_id", F.coalesce(F.expr(_PREFERRED).cast("int"), F.lit(-1)))


@query(
    f"""WITH {_CLUSTERED}, m AS (SELECT doc_id, cluster FROM c WHERE doc_id <> cluster)
    SELECT l.doc_id, coalesce(m.cluster, l.doc_id) AS mapped, l.toxic FROM (SELECT DISTINCT doc_id, toxic FROM doc_labels) l LEFT JOIN m USING (doc_id)"""
)
def cluster_remap(spark, folder):
    mapping = _text_clusters(spark, folder).where("doc_id <> cluster")
    labels = table(spark, folder, "doc_labels").select("doc_id", "toxic").distinct().withColumn("mapped", F.col("doc_id"))
    return dedup.remap(labels, "mapped", mapping, "doc_id", "cluster").select("doc_id", "mapped", "toxic")


@query(
    f"""WITH {_CLUSTERED}, n AS (SELECT *, row_number() OVER (ORDER BY cluster, doc_id) - 1 AS place FROM c),
    edge AS (SELECT max(cluster) AS cut FROM (SELECT cluster, min(place) AS first FROM n GROUP BY cluster) WHERE first <= greatest((SELECT count(*) FROM n) - 200, 0))
    SELECT doc_id, CASE WHEN cluster >= (SELECT cut FROM edge) THEN 'test' ELSE 'train' END AS split FROM n"""
)
def leak_free_split(spark, folder):
    return dedup.leak_free_split(_text_clusters(spark, folder), "cluster", "doc_id", 200).select("doc_id", "split")


@query(
    """SELECT query, array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(pos, []))), lambda x: x IS NOT NULL))), '|') AS pos,
    count(*) AS rows FROM train_data WHERE query IS NOT NULL GROUP BY query"""
)
def merged_by_question(spark, folder):
    rows = table(spark, folder, "train_data")
    merged = etl.merge_by(rows.withColumn("pos", F.coalesce("pos", F.array().cast("array<string>"))), "query", ["pos"])
    counts = rows.where("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("rows"))
    return merged.join(counts, "query").select("query", F.array_join("pos", "|").alias("pos"), "rows")


@query(
    """WITH f AS (SELECT law_id, min(oid) AS first FROM temp_legal_corpus_withstpvl WHERE law_id IS NOT NULL GROUP BY law_id)
    SELECT law_id, 'doc_' || (row_number() OVER (ORDER BY first, law_id) - 1) AS id FROM f"""
)
def dense_law_ids(spark, folder):
    return etl.dense_ids(table(spark, folder, "temp_legal_corpus_withstpvl"), "law_id", "oid", "doc_", "id")


@query(
    """SELECT row_number() OVER (ORDER BY part, place) - 1 AS oid, dataset, md5(coalesce(text, '')) AS digest FROM (
    SELECT 0 AS part, item_id AS place, 'eval' AS dataset, text FROM eval_items UNION ALL SELECT 1, doc_id, 'documents', text FROM documents)"""
)
def numbered_union(spark, folder):
    parts = [("eval", table(spark, folder, "eval_items").withColumnRenamed("item_id", "n")), ("documents", table(spark, folder, "documents").withColumnRenamed("doc_id", "n"))]
    return etl.union_with_oids(parts, "text", "n").select("oid", "dataset", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query(
    """WITH q AS (SELECT DISTINCT query FROM merged_train_data_ids WHERE query IS NOT NULL)
    SELECT split_part(query, '_', 1) AS prefix, count(*) AS ids FROM q GROUP BY 1"""
)
def prefix_counts(spark, folder):
    ids = table(spark, folder, "merged_train_data_ids").select("query").where("query IS NOT NULL").distinct()
    return ids.groupBy(F.split("query", "_")[0].alias("prefix")).agg(F.count("*").alias("ids"))


@query("SELECT coalesce(len(neg), 0) AS negatives, count(*) AS rows FROM merged_train_data_ids GROUP BY 1")
def list_length_histogram(spark, folder):
    rows = table(spark, folder, "merged_train_data_ids")
    return rows.groupBy(F.when(F.col("neg").isNull(), 0).otherwise(F.size("neg")).cast("long").alias("negatives")).agg(F.count("*").alias("rows"))


@query(
    """WITH r AS (SELECT DISTINCT unnest(list_concat(coalesce(pos, []), coalesce(neg, []))) AS id FROM merged_train_data_ids),
    c AS (SELECT DISTINCT p || oid AS id FROM temp_legal_corpus_withstpvl, (VALUES ('tvpl_oid_'), ('zalolegal_oid_')) v(p))
    SELECT id FROM r WHERE (id LIKE 'tvpl_oid_%' OR id LIKE 'zalolegal_oid_%') AND id NOT IN (SELECT id FROM c)"""
)
def missing_references(spark, folder):
    rows = table(spark, folder, "merged_train_data_ids")
    none = F.array().cast("array<string>")
    ids = rows.select(F.explode(F.concat(F.coalesce("pos", none), F.coalesce("neg", none))).alias("id")).where("id LIKE 'tvpl_oid_%' OR id LIKE 'zalolegal_oid_%'").distinct()
    oids = table(spark, folder, "temp_legal_corpus_withstpvl").select(F.explode(F.array(*[F.concat(F.lit(p), F.col("oid").cast("string")) for p in ("tvpl_oid_", "zalolegal_oid_")])).alias("id"))
    return etl.missing_ids(ids, oids, "id")


@query(
    """WITH c AS (SELECT 'c_' || oid AS id, max(text) AS text FROM temp_legal_corpus_withstpvl WHERE oid IS NOT NULL GROUP BY oid),
    e AS (SELECT 'e_' || item_id AS id, text FROM eval_items WHERE item_id IS NOT NULL)
    SELECT id, text FROM c UNION ALL SELECT id, text FROM e"""
)
def prefixed_texts(spark, folder):
    corpus = table(spark, folder, "temp_legal_corpus_withstpvl").groupBy("oid").agg(F.max("text").alias("text"))
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("oid"), "text")
    return etl.prefixed_union([("c_", corpus), ("e_", items)], "oid", "text")


@query(
    """WITH i AS (SELECT DISTINCT so_hieu FROM laws WHERE so_hieu IS NOT NULL), d AS (SELECT law_id, list_sort(list(DISTINCT dataset)) AS s
      FROM temp_legal_corpus_withstpvl WHERE law_id IS NOT NULL AND dataset IS NOT NULL GROUP BY law_id)
    SELECT so_hieu AS law_id, coalesce(array_to_string(s, ','), 'NOT FOUND') AS dataset FROM i LEFT JOIN d ON so_hieu = law_id"""
)
def law_datasets(spark, folder):
    items = table(spark, folder, "laws").where("so_hieu IS NOT NULL").select(F.col("so_hieu").alias("law_id"))
    labels = table(spark, folder, "temp_legal_corpus_withstpvl").where("law_id IS NOT NULL").select("law_id", "dataset")
    found = etl.grouped_labels(items, labels, "law_id", "dataset")
    return found.select("law_id", F.array_join("dataset", ",").alias("dataset"))


@query(
    """SELECT id, n - 1 AS place, content[n] AS paragraph FROM (SELECT id, content, unnest(range(1, len(content) + 1)) AS n FROM laws WHERE content IS NOT NULL)"""
)
def law_paragraphs(spark, folder):
    return table(spark, folder, "laws").select("id", F.posexplode("content").alias("place", "paragraph")).select("id", F.col("place").cast("long"), "paragraph")


@query("SELECT source, count(DISTINCT d.doc_id) AS toxic FROM documents d JOIN doc_labels l ON d.doc_id = l.doc_id AND l.toxic = 1 GROUP BY source")
def labelled_documents(spark, folder):
    toxic = table(spark, folder, "doc_labels").where("toxic = 1").select("doc_id").distinct()
    return table(spark, folder, "documents").join(toxic, "doc_id", "left_semi").groupBy("source").agg(F.countDistinct("doc_id").alias("toxic"))


@query(
    """WITH c AS (SELECT text, max(oid) AS oid FROM temp_legal_corpus_withstpvl WHERE text IS NOT NULL GROUP BY text)
    SELECT d.doc_id, c.oid FROM documents d JOIN c USING (text)"""
)
def ids_by_text(spark, folder):
    corpus = table(spark, folder, "temp_legal_corpus_withstpvl").where("text IS NOT NULL")
    return etl.ids_of_texts(_documents(spark, folder).select("doc_id", "text"), "text", corpus, "oid", "oid").select("doc_id", "oid")


# -- MinHash ---------------------------------------------------------------------------------------

BANDS, ROWS, COUNT = 25, 10, 250


def _signatures_sql() -> str:
    a, b = hashing.permutations(COUNT)
    values = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""w AS (SELECT doc_id, {_WORDS} AS w FROM {_DOCS} AND len({_PARTS}) >= 5),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM w),
    h AS (SELECT doc_id, ('0x' || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::UBIGINT AS h FROM (SELECT doc_id, sha1(s) AS d FROM s)),
    p(i, a, b) AS (SELECT i, a::UBIGINT, b::UBIGINT FROM (VALUES {values}) t(i, a, b)),
    m AS (SELECT doc_id, i, min(((a * h) % 4294967296 + b) % 4294967296 % 4294967291) AS v FROM h, p GROUP BY doc_id, i),
    f AS (SELECT doc_id, p.i, coalesce(m.v, 4294967295) AS v FROM w CROSS JOIN p LEFT JOIN m USING (doc_id, i)),
    sig AS (SELECT doc_id, (i // {ROWS})::INT AS band, string_agg(v::VARCHAR, ',' ORDER BY i) AS sig FROM f GROUP BY 1, 2)"""


def _signatures(spark, folder) -> DataFrame:
    rows = _documents(spark, folder).where(T.long_enough(F.col("text")))
    return hashing.band_signatures(rows, "doc_id", T.shingles(F.col("text")), BANDS, ROWS, COUNT)


@query(f"WITH {_signatures_sql()} SELECT doc_id, band, md5(sig) AS sig FROM sig")
def minhash_bands(spark, folder):
    return _signatures(spark, folder).select("doc_id", "band", F.md5("sig").alias("sig"))


_EDGES = "e AS (SELECT DISTINCT doc_id AS src, least AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, sig) AS least FROM sig) WHERE doc_id <> least)"


@query(f"WITH {_signatures_sql()}, {_EDGES} SELECT src, dst FROM e")
def lsh_candidates(spark, folder):
    return dedup.lsh_edges(stage(hashing.band_keys(_documents(spark, folder), "doc_id", "text", BANDS, ROWS)).where("band >= 0"), "doc_id")


_COMPONENTS = """linked AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    r(node, reached) AS (SELECT DISTINCT a, a FROM linked UNION SELECT r.node, linked.b FROM r JOIN linked ON r.reached = linked.a),
    k AS (SELECT node, min(reached) AS component FROM r GROUP BY node)"""


@query(
    f"""WITH RECURSIVE {_signatures_sql()}, {_EDGES}, {_COMPONENTS}
    SELECT w.doc_id, coalesce(component, w.doc_id) AS cluster FROM w LEFT JOIN k ON w.doc_id = k.node"""
)
def near_dup_clusters(spark, folder):
    return dedup.lsh_clusters(_documents(spark, folder), "doc_id", "text", bands=(BANDS, ROWS))


_CENTROID = r"""x AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '([\p{L}\p{N}_]+ *\p{Nd}*)', 1)) AS s FROM documents WHERE text IS NOT NULL),
    lab AS (SELECT w.doc_id, coalesce(component, w.doc_id) AS parent FROM w LEFT JOIN k ON w.doc_id = k.node),
    j AS (SELECT lab.doc_id, parent, len(list_intersect(x.s, y.s))::DOUBLE AS c, len(x.s) AS n, len(y.s) AS m FROM lab JOIN x ON x.doc_id = lab.doc_id JOIN x y ON y.doc_id = lab.parent)"""


@query(
    f"""WITH RECURSIVE {_signatures_sql()}, {_EDGES}, {_COMPONENTS}, {_CENTROID}
    SELECT doc_id, CASE WHEN score > 0.7 THEN parent ELSE doc_id END AS cluster, round(score, 6) AS score, parent FROM (SELECT *, CASE WHEN c > 0 THEN c / (n + m - c) ELSE 0 END AS score FROM j)"""
)
def near_dup_centroid(spark, folder):
    rows = _documents(spark, folder)
    found = dedup.verify_centroid(rows, "doc_id", "text", stage(dedup.lsh_clusters(rows, "doc_id", "text", bands=(BANDS, ROWS))), 0.7)
    return found.select("doc_id", "cluster", F.round("score", 6).alias("score"), "parent")


@query()
def near_dup_full(spark, folder):
    rows = _documents(spark, folder)
    return dedup.verify_full(rows, "doc_id", "text", stage(dedup.lsh_clusters(rows, "doc_id", "text", 0.4)), 0.52)


@query()
def near_dup_previous(spark, folder):
    rows = _documents(spark, folder)
    return dedup.verify_previous(rows, "doc_id", "text", stage(dedup.lsh_clusters(rows, "doc_id", "text", 0.4)), 0.52)


@query()
def question_clusters(spark, folder):
    """Second-level clusters over the questions of the training split."""
    rows = table(spark, folder, "train_data").select("sample_id", "query").dropDuplicates(["sample_id"])
    return dedup.near_dedup(rows, "sample_id", "query", cluster="__cluster_question__", jaccard_threshold=0.5).select("sample_id", "__cluster_question__")


# -- retrieval -------------------------------------------------------------------------------------


def _dense(spark, folder, k: int = 100) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return retrieval.knn_join(vectors.where("vec_id % 100 = 0"), vectors, k, "vec_id", "vec_id", skip_self=True)


_UNIT = "n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS s FROM n)"
_RANKED = """scored AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_inner_product(q.v, p.v) / (q.s * p.s) AS score FROM u q, u p WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM scored QUALIFY rank <= 100)"""


@query(f"WITH {_UNIT}, {_RANKED} SELECT qid, pid, round(score, 6) AS score, rank::INT AS rank FROM top")
def dense_topk(spark, folder):
    return _dense(spark, folder).select("qid", "pid", F.round("score", 6).alias("score"), "rank")


def _labelled(spark, folder, found: DataFrame) -> DataFrame:
    """``found`` with ``hit``: whether passage and query have the same label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("_l"))
    return found.join(asked, "qid").join(labels.withColumnRenamed("vec_id", "pid"), "pid").withColumn("hit", F.col("_l") == F.col("label")).drop("_l", "label")


def _same_label(spark, folder) -> DataFrame:
    """How many other vectors have the label of each query; the pairs themselves are never made."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    return vectors.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("qid"), "relevant")


def _metrics_sql() -> str:
    parts = []
    for k in (1, 5, 10, 100):
        parts += [
            f"SELECT 'accuracy' AS metric, {k} AS k, avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0 END) AS value FROM s",
            f"SELECT 'precision', {k}, avg(h{k} / {k}.0) FROM s", f"SELECT 'recall', {k}, avg(h{k}::DOUBLE / n) FROM s",
        ]
    for k in (5, 10, 100):
        ideal = f"list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1)))"
        parts += [
            f"SELECT 'mrr', {k}, avg(coalesce(1.0 / f{k}, 0)) FROM s", f"SELECT 'ndcg', {k}, avg(d{k} / {ideal}) FROM s", f"SELECT 'map', {k}, avg(a{k} / least(n, {k})) FROM s",
        ]
    sums = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS h{k}, min(CASE WHEN rank <= {k} AND hit = 1 THEN rank END) AS f{k}, "
        f"sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN rank <= {k} THEN hit * running / rank ELSE 0 END) AS a{k}"
        for k in (1, 5, 10, 100)
    )
    return f"""WITH {_UNIT}, {_RANKED}, rel AS (SELECT q.vec_id AS qid, p.vec_id AS pid FROM u q JOIN u p ON q.label = p.label AND q.vec_id <> p.vec_id AND q.vec_id % 100 = 0),
    c AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
    m AS (SELECT top.qid, rank, CASE WHEN rel.pid IS NULL THEN 0 ELSE 1 END AS hit, n FROM top LEFT JOIN rel ON top.qid = rel.qid AND top.pid = rel.pid JOIN c ON c.qid = top.qid),
    r AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS running FROM m),
    s AS (SELECT qid, any_value(n) AS n, {sums} FROM r GROUP BY qid), v AS ({" UNION ALL ".join(parts)})
    SELECT metric, k::INT AS k, round(value, 6) AS value FROM v"""


@query(_metrics_sql())
def dense_metrics(spark, folder):
    found = metrics.evaluate_marked(_labelled(spark, folder, _dense(spark, folder)), _same_label(spark, folder))
    return found.select("metric", "k", F.round("value", 6).alias("value"))


_STOPPED = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS) + "]"
_TERMS = f"list_filter({_PARTS}, lambda t: t <> '' AND t <> '_' AND NOT list_contains({_STOPPED}, t))"
_POSTINGS = f"""d AS (SELECT doc_id AS pid, {_TERMS} AS terms FROM {_DOCS}), c AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
    p AS (SELECT pid, term, dl, count(*) AS tf FROM (SELECT pid, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


@query(f"WITH {_POSTINGS} SELECT term, df FROM df")
def term_frequencies(spark, folder):
    return retrieval.document_frequencies(retrieval.postings(_documents(spark, folder), "doc_id", T.search_terms(F.col("text"))))


@query(
    f"""WITH {_POSTINGS}, raw AS (SELECT DISTINCT qid, query AS text FROM dev_queries WHERE query IS NOT NULL AND split_part(qid, '_', 2)::INT % 100 = 0),
    q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TERMS}) AS term FROM raw) GROUP BY ALL),
    w AS (SELECT qid, q.term, qtf, ln((n + 1) / df) AS idf FROM q JOIN df USING (term), c), k AS (SELECT qid, sum(qtf * idf) AS base FROM w GROUP BY qid),
    s AS (SELECT w.qid, pid, sum(qtf * idf * tf * 1.6 / (0.6 * (0.1 + 0.9 * dl / mean) + tf)) AS part FROM w JOIN p USING (term), c GROUP BY w.qid, pid),
    r AS (SELECT qid, pid, part + base AS score, row_number() OVER (PARTITION BY qid ORDER BY round(part + base, 9) DESC, pid) AS rank FROM s JOIN k USING (qid) QUALIFY rank <= 100)
    SELECT qid, pid, round(score, 5) AS score, rank::INT AS rank FROM r"""
)
def bm25_topk(spark, folder):
    asked = table(spark, folder, "dev_queries").select("qid", "query").where("query IS NOT NULL").distinct().where(T.id_number(F.col("qid")) % 100 == 0)
    found = retrieval.bm25(asked, "qid", T.search_terms(F.col("query")), _documents(spark, folder), "doc_id", T.search_terms(F.col("text")), k=None)
    found = retrieval.top_k(found.withColumn("_s", F.round("score", 9)).drop("rank"), 100, score="_s")
    return found.select("qid", "pid", F.round("score", 5).alias("score"), "rank")


_EUCLIDEAN = """near AS (SELECT q.vec_id AS qid, p.vec_id AS pid, list_inner_product(q.v, p.v) AS score FROM u q, u p WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
    second AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM near QUALIFY rank <= 100)"""


def _two_rankings(spark, folder) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    return _dense(spark, folder), retrieval.knn_join(vectors.where("vec_id % 100 = 0"), vectors, 100, "vec_id", "vec_id", metric="dot", skip_self=True)


@query(
    f"""WITH {_UNIT}, {_RANKED}, {_EUCLIDEAN}, f AS (SELECT w AS weight, coalesce(top.qid, second.qid) AS qid, coalesce(top.pid, second.pid) AS pid,
      (1 - w) * coalesce(1.0 / (top.rank + 10), 0) + w * coalesce(1.0 / (second.rank + 10), 0) AS score
      FROM top FULL JOIN second ON top.qid = second.qid AND top.pid = second.pid, (VALUES (0.1), (0.2), (0.5)) x(w))
    SELECT weight::DOUBLE AS weight, qid, pid, round(score, 9) AS score FROM f"""
)
def rrf_sweep(spark, folder):
    first, second = _two_rankings(spark, folder)
    return retrieval.rrf(first, second, 10, [0.1, 0.2, 0.5]).select("weight", "qid", "pid", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_UNIT}, {_RANKED}, c AS (SELECT qid, pid, q.v AS qv, p.v AS pv FROM top JOIN u q ON q.vec_id = qid JOIN u p ON p.vec_id = pid WHERE rank <= 20),
    a AS (SELECT qid, pid, i, max(list_inner_product(qv[i * 8 + 1:i * 8 + 8], pv[j * 8 + 1:j * 8 + 8])) AS best FROM c, range(8) x(i), range(8) y(j) GROUP BY qid, pid, i)
    SELECT qid, pid, round(avg(best), 6) AS score FROM a GROUP BY qid, pid"""
)
def maxsim_rerank(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("m"))
    near = _dense(spark, folder, 20)
    pairs = near.join(vectors.select(F.col("vec_id").alias("qid"), F.col("m").alias("qm")), "qid").join(vectors.select(F.col("vec_id").alias("pid"), F.col("m").alias("pm")), "pid")
    scores = retrieval.max_sim(pairs.drop("score"), "qm", "pm")
    return retrieval.rerank(near, scores).select("qid", "pid", F.round("score", 6).alias("score"))


@query(
    f"""WITH q AS (SELECT item_id AS qid, token, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({_TERMS}) AS token FROM eval_items WHERE item_id % 100 = 0 AND text IS NOT NULL) GROUP BY ALL),
    d AS (SELECT doc_id AS pid, token, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest({_TERMS}) AS token FROM {_DOCS}) GROUP BY ALL)
    SELECT qid, pid, sum(q.w * d.w) AS score FROM q JOIN d USING (token) GROUP BY qid, pid"""
)
def lexical_match(spark, folder):
    def weights(df, key, name):
        each = df.select(F.col(key).alias(name), F.explode(T.search_terms(F.col("text"))).alias("token"))
        return each.groupBy(name, "token").agg(F.count("*").cast("double").alias("weight"))

    items = table(spark, folder, "eval_items").where("item_id % 100 = 0 AND text IS NOT NULL")
    return retrieval.lexical_scores(weights(items, "item_id", "qid"), weights(_documents(spark, folder), "doc_id", "pid"))


@query(
    f"""WITH {_UNIT}, {_RANKED}, c AS (SELECT qid, rank, 'd' || (pid % 40) AS parent FROM top), o AS (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY rank) AS n FROM c)
    SELECT qid, rank::INT AS rank, CASE WHEN n = 1 THEN parent ELSE 'already_exist' END AS pid FROM o"""
)
def chunk_collapse(spark, folder):
    found = _dense(spark, folder).withColumn("pid", F.concat(F.lit("d"), (F.col("pid") % 40).cast("string"), F.lit("_"), F.col("pid").cast("string")))
    return retrieval.collapse_chunks(found).select("qid", "rank", "pid")


@query(
    f"""WITH {_UNIT}, {_RANKED}, pool AS (SELECT qid, pid FROM top JOIN u a ON a.vec_id = qid JOIN u b ON b.vec_id = pid WHERE rank > 2 AND rank <= 60 AND a.label <> b.label)
    SELECT qid, pid, (row_number() OVER (PARTITION BY qid ORDER BY md5(qid || ':' || pid || ':42')))::INT AS place FROM pool QUALIFY place <= 15"""
)
def hard_negatives(spark, folder):
    near = stage(_labelled(spark, folder, _dense(spark, folder)))
    return negatives.mine_negatives(near.drop("hit"), near.where("hit").select("qid", "pid"), 2, 60, 15)


@query(f"WITH {_UNIT}, {_RANKED} SELECT count(*) AS leaking FROM top JOIN u a ON a.vec_id = qid JOIN u b ON b.vec_id = pid WHERE rank > 2 AND rank <= 17 AND a.label = b.label")
def negative_audit(spark, folder):
    """How many of the negatives taken by rank alone are positives of their query."""
    near = stage(_labelled(spark, folder, _dense(spark, folder)))
    taken = near.where("rank > 2 AND rank <= 17").select("qid", "pid")
    leaking = negatives.leaking_negatives(taken, near.where("hit").select("qid", "pid"))
    return spark.createDataFrame([(leaking,)], "leaking long")


@query(
    """WITH t AS (SELECT DISTINCT ON (sample_id) sample_id, neg, neg_scores, list_min(pos_scores) - 0.1::FLOAT AS lim FROM train_data_minedhn),
    z AS (SELECT sample_id, neg, neg_scores, lim, unnest(range(1, greatest(coalesce(len(neg), 0), 1) + 1)) AS i FROM t)
    SELECT sample_id, sum(CASE WHEN neg[i] IS NOT NULL AND neg_scores[i] <= lim THEN 1 ELSE 0 END)::BIGINT AS kept FROM z GROUP BY sample_id"""
)
def margin_kept(spark, folder):
    rows = table(spark, folder, "train_data_minedhn").dropDuplicates(["sample_id"])
    kept = negatives.margin_filter(rows, F.lit(0.1).cast("float"))
    return kept.select("sample_id", F.size("neg_kept").cast("long").alias("kept"))


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM {_DOCS}), e AS (SELECT doc_id, unnest(w) AS word FROM w), c AS (SELECT word, count(*) AS c FROM e GROUP BY word),
    t AS (SELECT (SELECT sum(c) FROM c) + (SELECT count(*) FROM w) + (SELECT count(*) FROM c) + 1 AS whole, (SELECT count(*) FROM w) AS texts),
    l AS (SELECT doc_id, sum(log10((c + 1) / whole)) AS l FROM e JOIN c USING (word), t GROUP BY doc_id)
    SELECT w.doc_id, round(pow(10, -(coalesce(l, 0) + log10((texts + 1) / whole)) / (len(w) + 1)), 4) AS perplexity FROM w LEFT JOIN l USING (doc_id), t"""
)
def unigram_perplexity(spark, folder):
    return models.unigram_perplexity(_documents(spark, folder), "doc_id", "text").select("doc_id", F.round("perplexity", 4).alias("perplexity"))


# -- training data and functions that SQL can't state ------------------------------------------------


@query()
def sampled_groups(spark, folder):
    rows = table(spark, folder, "train_data").dropDuplicates(["sample_id"])
    return training.sampled_group(rows, "sample_id", 8, 42).select("sample_id", "passages", "labels")


@query()
def batch_plan(spark, folder):
    rows = sample_lengths(spark, folder)
    size = training.batch_rows(F.col("bucket"), 16, {"0-500": 48, "500-2000": 32})
    plan = training.epoch_plan(rows, "bucket", "sample_id", size, processes=2, seed=7)
    return training.process_slice(plan, 2).select("bucket", "sample_id", "batch", "place", "process")


@query()
def document_chunks(spark, folder):
    rows = _documents(spark, folder).select("doc_id", F.posexplode(T.chunks()("text")).alias("at", "chunk"))
    return rows.select(F.concat_ws("_", "doc_id", "at").alias("chunk_id"), "chunk")


@query()
def document_sentences(spark, folder):
    return _documents(spark, folder).select("doc_id", T.sentences_with_fillers("text").alias("p")).select("doc_id", "p.sentences", "p.fillers")


@query()
def translation_forms(spark, folder):
    return _documents(spark, folder).select("doc_id", T.normalize_for_translation("text").alias("plain"), T.strip_accents("text").alias("unaccented"))


@query()
def encoded_documents(spark, folder):
    return models.encode(_documents(spark, folder), "doc_id", "text", models.hashed_encoder(32))
