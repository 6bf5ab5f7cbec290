"""Further queries, one for each family of operators, over the test tables, each with equivalent SQL where SQL can state it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import hashing, text as T
from corpusloom.operators import dedup, etl, html, metrics, models, negatives, queries as Q, retrieval, setpairs, training
from corpusloom.plans.staging import own_folder, stage
from corpusloom.session import table
from corpusloom.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def drawn_sql(seed: int, *keys: str) -> str:
    """``text.seeded`` in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{seed}')), 1, 12))::UBIGINT::DOUBLE / 281474976710656"


# -- text functions ------------------------------------------------------------------------------

_MARKS = "".join(T.PUNCTUATION).replace("'", "''")


@query(
    rf"""SELECT doc_id, md5(regexp_replace(text, '\p{{C}}', ' ', 'g')) AS printable, md5(translate(text, chr(160) || chr(8203), '')) AS dropped, md5(translate(text, chr(160) || chr(8203), ' ')) AS plain,
    md5(regexp_replace(text, '^[!-/:-@\[-`{{-~ ]+', '')) AS stripped, md5(translate(text, '{_MARKS}', '')) AS unpunctuated, md5('query: ' || text) AS instructed FROM documents WHERE text IS NOT NULL"""
)
def text_forms(spark, folder):
    t = F.col("text")
    forms = {
        "printable": T.printable(t), "dropped": T.drop_blanks(t), "plain": T.plain_blanks(t), "stripped": T.strip_leading(t),
        "unpunctuated": T.without_punctuation(t), "instructed": T.with_instruction(t, "query: "),
    }
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", *(F.md5(c).alias(n) for n, c in forms.items()))


@query("SELECT doc_id, md5(strip_accents(text)) AS unaccented FROM documents WHERE text IS NOT NULL")
def unaccented_texts(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.strip_accents("text")).alias("unaccented"))


@query("SELECT doc_id, round(1 / (1 + exp(-(n_chars - 500) / 500.0)), 9) AS weight FROM documents WHERE n_chars IS NOT NULL")
def sigmoid_weights(spark, folder):
    rows = table(spark, folder, "documents").where("n_chars IS NOT NULL")
    return rows.select("doc_id", F.round(T.sigmoid((F.col("n_chars") - 500) / 500.0), 9).alias("weight"))


def _number_sql(digits: int) -> str:
    return "('0x' || " + " || ".join(f"substr(d, {2 * i + 1}, 2)" for i in reversed(range(digits))) + ")::UBIGINT::VARCHAR"


@query(f"SELECT doc_id, {_number_sql(2)} AS h16, {_number_sql(4)} AS h32, {_number_sql(8)} AS h64, sha256(text) AS sha FROM (SELECT doc_id, text, sha1(text) AS d FROM documents WHERE text IS NOT NULL)")
def digest_numbers(spark, folder):
    numbers = [hashing.sha1_digits(F.col("text"), bits).alias(f"h{bits}") for bits in (16, 32, 64)]
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", *numbers, F.sha2("text", 256).alias("sha"))


@query(
    """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS total, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM n"""
)
def unit_vectors(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", T.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


# -- references ----------------------------------------------------------------------------------


def _references(spark, folder) -> DataFrame:
    """Distinct rows of ids with a key made of their content."""
    key = F.md5(F.concat_ws("|", F.coalesce("query", F.lit("")), F.coalesce(F.array_join("pos", ","), F.lit(""))))
    return table(spark, folder, "merged_train_data_ids").select(key.alias("key"), "query", "pos").distinct()


_REFERENCES = "r AS (SELECT DISTINCT md5(coalesce(query, '') || '|' || coalesce(array_to_string(pos, ','), '')) AS key, query, pos FROM merged_train_data_ids)"
_CORPUS = "c AS (SELECT 'tvpl_oid_' || oid AS id, max(text) AS text, max(law_id) AS law FROM temp_legal_corpus_withstpvl WHERE oid IS NOT NULL GROUP BY oid)"


def _corpus(spark, folder) -> DataFrame:
    rows = table(spark, folder, "temp_legal_corpus_withstpvl").where("oid IS NOT NULL").groupBy("oid").agg(F.max("text").alias("text"), F.max("law_id").alias("law"))
    return rows.select(F.concat(F.lit("tvpl_oid_"), F.col("oid").cast("string")).alias("id"), "text", "law")


@query(
    f"""WITH {_REFERENCES}, {_CORPUS}, i AS (SELECT key, unnest(range(1, len(pos) + 1)) AS nth, pos FROM r),
    t AS (SELECT key, list(md5(text) ORDER BY nth) AS texts FROM i JOIN c ON c.id = pos[nth] WHERE text IS NOT NULL GROUP BY key)
    SELECT r.key, coalesce(array_to_string(texts, ','), '') AS texts FROM r LEFT JOIN t USING (key)"""
)
def referenced_texts(spark, folder):
    corpus = _corpus(spark, folder).where("text IS NOT NULL").select("id", F.md5("text").alias("digest"))
    found = etl.texts_of_ids(_references(spark, folder), "key", "pos", corpus, "id", "digest", "texts")
    return found.select("key", F.array_join("texts", ",").alias("texts"))


@query(
    f"""WITH {_REFERENCES}, {_CORPUS}, i AS (SELECT key, unnest(range(1, len(pos) + 1)) AS nth, pos FROM r),
    t AS (SELECT key, list(coalesce(law, pos[nth]) ORDER BY nth) AS mapped FROM i LEFT JOIN c ON c.id = pos[nth] GROUP BY key)
    SELECT r.key, array_to_string(coalesce(mapped, pos), ',') AS mapped FROM r LEFT JOIN t USING (key)"""
)
def remapped_references(spark, folder):
    mapping = _corpus(spark, folder).where("law IS NOT NULL")
    found = dedup.remap_array(_references(spark, folder), "key", "pos", mapping, "id", "law")
    return found.select("key", F.array_join("pos", ",").alias("mapped"))


@query(
    f"""WITH {_REFERENCES}, i AS (SELECT key, pos, unnest(range(1, len(pos) + 1)) AS nth FROM r),
    k AS (SELECT key, list(pos[nth] ORDER BY nth) AS kept FROM i WHERE split_part(pos[nth], '_', 1) IN (SELECT source FROM mix_targets WHERE mix = 'pairs') GROUP BY key)
    SELECT r.key, coalesce(array_to_string(kept, ','), '') AS kept FROM r LEFT JOIN k USING (key)"""
)
def kept_references(spark, folder):
    rows = _references(spark, folder).withColumn("pos", F.coalesce("pos", F.array().cast("array<string>"))).withColumn("labels", F.transform("pos", lambda p: F.split(p, "_")[0]))
    allowed = table(spark, folder, "mix_targets").where("mix = 'pairs'")
    return etl.keep_in(rows, "key", "pos", "labels", allowed, "source").select("key", F.array_join("pos", ",").alias("kept"))


@query(
    """WITH u AS (SELECT DISTINCT unnest(pos) AS id FROM merged_train_data_ids)
    SELECT id, CASE WHEN id LIKE 'tvpl\\_oid\\_%' ESCAPE '\\' THEN 'tvpl_oid_' WHEN id LIKE 'zalolegal\\_oid\\_%' ESCAPE '\\' THEN 'zalolegal_oid_' END AS prefix,
    CASE WHEN id LIKE 'tvpl\\_oid\\_%' ESCAPE '\\' THEN substr(id, 10) WHEN id LIKE 'zalolegal\\_oid\\_%' ESCAPE '\\' THEN substr(id, 15) END AS rest FROM u WHERE id IS NOT NULL""".replace("\\\\", "\\")
)
def routed_references(spark, folder):
    ids = table(spark, folder, "merged_train_data_ids").select(F.explode("pos").alias("id")).where("id IS NOT NULL").distinct()
    prefix, rest = etl.routed_ids(F.col("id"), ["tvpl_oid_", "zalolegal_oid_"])
    return ids.select("id", prefix.alias("prefix"), rest.alias("rest"))


@query(
    f"""WITH {_CORPUS}, u AS (SELECT DISTINCT query AS qid, unnest(pos) AS pid FROM merged_train_data_ids WHERE query IS NOT NULL),
    f AS (SELECT 'cluster_' || item_id AS id, text FROM eval_items), n AS (SELECT 'oid_' || substr(id, 10) AS id, text FROM c UNION ALL SELECT * FROM f)
    SELECT qid, pid, md5(text) AS digest FROM (SELECT qid, replace(replace(pid, 'tvpl_oid_', 'oid_'), 'zalolegal_oid_', 'oid_') AS pid FROM u) JOIN n ON id = pid WHERE text IS NOT NULL"""
)
def resolved_positives(spark, folder):
    ids = table(spark, folder, "merged_train_data_ids").where("query IS NOT NULL").select(F.col("query").alias("qid"), F.explode("pos").alias("pid")).distinct()
    plain = F.replace(F.replace("pid", F.lit("tvpl_oid_"), F.lit("oid_")), F.lit("zalolegal_oid_"), F.lit("oid_"))
    corpus = _corpus(spark, folder).select(F.substring("id", 10, 30).alias("id"), "text")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")
    return negatives.resolve_positives(ids.withColumn("pid", plain), corpus, items).where("text IS NOT NULL").select("qid", "pid", F.md5("text").alias("digest"))


@query("SELECT DISTINCT law_id FROM temp_legal_corpus_withstpvl WHERE law_id IS NOT NULL AND law_id NOT IN (SELECT so_hieu FROM laws WHERE so_hieu IS NOT NULL)")
def missing_laws(spark, folder):
    """References of the corpus to laws that are not there."""
    ids = table(spark, folder, "temp_legal_corpus_withstpvl").select("law_id").where("law_id IS NOT NULL").distinct()
    return etl.missing_ids(ids, table(spark, folder, "laws").select(F.col("so_hieu").alias("law_id")).where("law_id IS NOT NULL"), "law_id")


@query("SELECT DISTINCT query FROM train_data WHERE query IN (SELECT query FROM train_data_minedhn WHERE query IS NOT NULL)")
def common_questions(spark, folder):
    return etl.common_keys(table(spark, folder, "train_data"), table(spark, folder, "train_data_minedhn"), "query")


# -- filters, positions, files -----------------------------------------------------------------------


@query("SELECT DISTINCT sample_id FROM train_data WHERE len(pos) >= 1 AND len(neg) >= 1")
def answered_samples(spark, folder):
    return etl.non_empty(table(spark, folder, "train_data"), "pos", "neg").select("sample_id").distinct()


@query(
    f"""SELECT DISTINCT sample_id FROM train_data WHERE query IS NOT NULL AND pos[1] IS NOT NULL AND len({Q._WORDS.replace("lower(text)", "lower(query)")}) <= 30 AND len({Q._WORDS.replace("lower(text)", "lower(pos[1])")}) <= 30"""
)
def capped_pairs(spark, folder):
    rows = table(spark, folder, "train_data").select("sample_id", "query", F.get("pos", F.lit(0)).alias("answer"))
    return etl.sound_pairs(rows, "query", "answer", lambda t: F.size(F.filter(T.tokens(t), lambda w: w != "")), 30).select("sample_id").distinct()


_POSITIONS = "p AS (SELECT item_id, row_number() OVER (ORDER BY length(text) DESC NULLS LAST, item_id) - 1 AS pos FROM eval_items)"


def _positions(spark, folder) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", (-F.coalesce(F.length("text"), F.lit(-1))).alias("_n"))
    return etl.row_index(items, ["_n", "item_id"]).select("item_id", "pos")


@query(f"WITH {_POSITIONS} SELECT item_id, pos FROM p WHERE pos IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)")
def chosen_positions(spark, folder):
    chosen = table(spark, folder, "documents").where("doc_id % 7 = 0")
    return etl.at_positions(_positions(spark, folder), "pos", chosen, "doc_id").select("item_id", "pos")


@query(f"WITH {_POSITIONS} SELECT item_id, (pos // 35)::INT AS shard, CASE WHEN pos >= 240 - 50 THEN 'test' ELSE 'train' END AS split FROM p")
def position_shards(spark, folder):
    return etl.last_rows_as_test(etl.shard(_positions(spark, folder), "pos", 7, 240), "pos", 50, 240).select("item_id", "shard", "split")


@query("SELECT qid, row_number() OVER (ORDER BY split_part(qid, '_', -1)::INT, qid) - 1 AS place FROM (SELECT DISTINCT qid FROM dev_queries)")
def ids_in_order(spark, folder):
    """The place of every id in the order of the number behind its last ``_``, as ``by_number`` sorts."""
    ids = table(spark, folder, "dev_queries").select("qid").distinct().withColumn("_n", T.id_number(F.col("qid")))
    return etl.row_index(ids, ["_n", "qid"], "place").select("qid", "place")


_FILES = "f AS (SELECT doc_id, source || '_' || coalesce(law_id, 'none') AS file, doc_id % 5 AS batch FROM documents)"


@query(
    f"""WITH {_FILES}, c AS (SELECT file, count(*) AS n FROM f GROUP BY file), d AS (SELECT file, CASE WHEN n < 3 THEN 'merged' ELSE file END AS dataset, n FROM c),
    s AS (SELECT dataset, sum(n) AS size FROM d GROUP BY dataset) SELECT doc_id, dataset FROM f JOIN d USING (file) JOIN s USING (dataset) WHERE dataset <> 'merged' OR size >= 2"""
)
def merged_files(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.concat_ws("_", "source", F.coalesce("law_id", F.lit("none"))).alias("file"))
    return training.merge_small(rows, "file", 3, 2).select("doc_id", "dataset")


@query("SELECT source, regexp_extract(source, '[^_]*$') AS suffix, CASE WHEN source LIKE '%\\_en' ESCAPE '\\' THEN 'en' ELSE 'vi' END AS language FROM (SELECT DISTINCT source FROM documents)".replace("\\\\", "\\"))
def file_suffixes(spark, folder):
    names = table(spark, folder, "documents").select("source").distinct()
    return names.select("source", training.size_suffix(F.col("source")).alias("suffix"), etl.file_language(F.col("source")).alias("language"))


# -- training data -----------------------------------------------------------------------------------


@query(
    f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS nth
    FROM (SELECT source, doc_id, {drawn_sql(11, "doc_id")} AS h FROM documents WHERE source IS NOT NULL)) WHERE nth <= 40"""
)
def capped_sources(spark, folder):
    return training.cap_rows(table(spark, folder, "documents").where("source IS NOT NULL"), "source", "doc_id", 40, 11).select("source", "doc_id")


@query(
    f"""WITH v AS (SELECT sample_id, max(query) AS vi FROM train_data GROUP BY sample_id), e AS (SELECT sample_id, max(pos[1]) AS en FROM train_data_minedhn GROUP BY sample_id)
    SELECT sample_id, CASE WHEN {drawn_sql(5, "sample_id")} < 0.5 THEN vi ELSE en END AS main, CASE WHEN {drawn_sql(5, "sample_id")} < 0.5 THEN en ELSE vi END AS other FROM v JOIN e USING (sample_id)"""
)
def picked_languages(spark, folder):
    vi = table(spark, folder, "train_data").groupBy("sample_id").agg(F.max("query").alias("text"))
    en = table(spark, folder, "train_data_minedhn").groupBy("sample_id").agg(F.max(F.get("pos", F.lit(0))).alias("text"))
    main, other = training.picked_language("sample_id", 5)
    return etl.parallel_texts(vi, en, "sample_id", "text").select("sample_id", main.alias("main"), other.alias("other"))


@query(
    f"""WITH n AS (SELECT sample_id, max(query) AS title, max(pos[1]) AS lead, max(neg[1]) AS body FROM train_data GROUP BY sample_id),
    d AS (SELECT *, trim(coalesce(lead, '')) = '' AS nl, trim(coalesce(body, '')) = '' AS nb, floor({drawn_sql(9, "sample_id")} * 3) AS draw FROM n)
    SELECT sample_id, CASE WHEN nl OR nb THEN title WHEN draw = 2 THEN lead ELSE title END AS query, CASE WHEN nl THEN body WHEN nb THEN lead WHEN draw = 0 THEN lead ELSE body END AS passage FROM d"""
)
def news_pairs(spark, folder):
    first = lambda c: F.max(F.get(c, F.lit(0)))
    rows = table(spark, folder, "train_data").groupBy("sample_id").agg(F.max("query").alias("title"), first("pos").alias("lead"), first("neg").alias("body"))
    asked, passage = training.chosen_pair("title", "lead", "body", "sample_id", 9)
    return rows.select("sample_id", asked.alias("query"), passage.alias("passage"))


@query(
    """WITH f AS (SELECT id, list_filter(content, lambda c: length(c) >= 20) AS fit FROM laws), x AS (SELECT id, fit, unnest(range(1, len(fit) + 1)) AS i FROM f WHERE len(fit) >= 2),
    o AS (SELECT id, fit[i] AS c, row_number() OVER (PARTITION BY id ORDER BY md5(id || ':' || (i - 1) || ':4'), fit[i]) AS n FROM x)
    SELECT a.id, a.c AS query, b.c AS passage FROM o a JOIN o b ON a.id = b.id AND a.n = 1 AND b.n = 2"""
)
def chunk_pairs(spark, folder):
    return training.chunk_pair(table(spark, folder, "laws"), "content", "id", F.length, 20, 4).select("id", "query", "passage")


@query(
    """WITH q AS (SELECT item_id, any_value(qa_pairs) AS qa FROM qa_items WHERE item_id < 200 OR item_id >= 200 GROUP BY item_id), d AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS c FROM q WHERE len(qa) > 0),
    x AS (SELECT item_id, c, qa, unnest(range(1, len(qa) + 1)) AS i FROM d), y AS (SELECT item_id, c, qa[i].question AS question, i FROM x WHERE qa[i] IS NOT NULL AND i % 3 <> 0)
    SELECT 'doc_' || dense_rank() OVER (ORDER BY c) - 1 AS doc_id, 'query_' || (row_number() OVER (ORDER BY c, i) - 1) AS qid, item_id::VARCHAR AS title, question FROM y""".replace("'doc_' || dense_rank() OVER (ORDER BY c) - 1", "'doc_' || (dense_rank() OVER (ORDER BY c) - 1)").replace(
        " WHERE item_id < 200 OR item_id >= 200", ""
    )
)
def squad_rows(spark, folder):
    """Pages as documents of one paragraph with its questions; every third one is marked as unanswerable."""
    pages = table(spark, folder, "qa_items").groupBy("item_id").agg(F.any_value("qa_pairs").alias("qa")).where("size(qa) > 0")
    asked = F.filter(F.transform("qa", lambda q, i: F.when(q.isNotNull(), F.struct(q["question"].alias("question"), ((i + 1) % 3 == 0).alias("is_impossible")))), lambda q: q.isNotNull())
    docs = pages.select("item_id", F.struct(F.col("item_id").cast("string").alias("title"), F.array(F.struct(F.lit("").alias("context"), asked.alias("qas"))).alias("paragraphs")).alias("doc"))
    whole = docs.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "doc"))), lambda s: s["doc"]).alias("data"))  # the layout of the file: one record
    return etl.flatten_squad(whole).select("doc_id", "qid", "title", "question")


_SAMPLES = "t AS (SELECT DISTINCT ON (sample_id) sample_id, pos, neg FROM train_data)"


@query(
    f"""WITH {_SAMPLES}, s AS (SELECT sample_id, CASE WHEN len(pos) > 0 THEN pos[(floor({drawn_sql(42, "sample_id")} * len(pos)) + 1)::INT] END AS one, coalesce(neg, []) AS neg FROM t),
    r AS (SELECT sample_id, one, flatten(list_transform(range(greatest(ceil(7.0 / nullif(len(neg), 0)), 1)::INT), lambda x: neg)) AS neg FROM s),
    x AS (SELECT sample_id, neg, unnest(range(1, len(neg) + 1)) AS i FROM r),
    o AS (SELECT sample_id, neg[i] AS n, row_number() OVER (PARTITION BY sample_id ORDER BY md5(sample_id || ':' || (i - 1) || ':42')) AS nth FROM x QUALIFY nth <= 7),
    g AS (SELECT sample_id, list(coalesce(n, '-') ORDER BY nth) AS drawn FROM o GROUP BY sample_id)
    SELECT sample_id, CASE WHEN one IS NULL THEN NULL ELSE array_to_string(list_concat([one], coalesce(drawn, [])), '|') END AS passages, CASE WHEN one IS NULL THEN NULL ELSE 1 + coalesce(len(drawn), 0) END AS labels FROM s LEFT JOIN g USING (sample_id)"""
)
def sampled_groups(spark, folder):
    rows = table(spark, folder, "train_data").dropDuplicates(["sample_id"])
    found = training.sampled_group(rows, "sample_id", 8, 42)
    return found.select("sample_id", F.array_join(F.transform("passages", lambda p: F.coalesce(p, F.lit("-"))), "|").alias("passages"), F.when(F.col("labels").isNotNull(), F.size("labels")).cast("long").alias("labels"))


_PLAN = f"""l AS (SELECT sample_id, bucket, CASE WHEN bucket = '0-500' THEN 48 WHEN bucket = '500-2000' THEN 32 ELSE 16 END * 2 AS size, {drawn_sql(7, "bucket", "sample_id")} AS h FROM ({Q.ORACLES["sample_lengths"]})),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, sample_id) - 1 AS nth, count(*) OVER (PARTITION BY bucket) AS total FROM l),
    s AS (SELECT *, nth // size AS step, least(size, total - (nth // size) * size) AS rows FROM o), k AS (SELECT * FROM s WHERE rows = size OR rows >= 4),
    d AS (SELECT bucket, step, row_number() OVER (ORDER BY draw, bucket, step) - 1 AS batch FROM (SELECT DISTINCT bucket, step, {drawn_sql(14, "bucket", "step")} AS draw FROM k))"""


@query(f"WITH {_PLAN} SELECT k.bucket, sample_id, batch, (nth - k.step * size)::INT AS place, floor((nth - k.step * size) / floor(rows / 2))::INT AS process FROM k JOIN d ON k.bucket = d.bucket AND k.step = d.step WHERE nth - k.step * size < floor(rows / 2) * 2")
def batch_plan(spark, folder):
    return Q.batch_plan(spark, folder)


# -- negatives ---------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT DISTINCT ON (sample_id) * FROM train_data_minedhn), l AS (SELECT sample_id, neg, neg_scores, list_min(pos_scores) - 0.2::FLOAT AS lim, unnest(range(1, len(neg) + 1)) AS i FROM t WHERE len(pos_scores) > 0),
    low AS (SELECT sample_id, neg[i] AS n, i, i % 2 AS system FROM l WHERE neg[i] IS NOT NULL AND neg_scores[i] <= lim),
    a AS (SELECT *, 0 AS s FROM (SELECT sample_id, n, min(i) AS i FROM low WHERE system = 1 GROUP BY sample_id, n) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY i) <= 3),
    b AS (SELECT *, 1 AS s FROM (SELECT sample_id, n, min(i) AS i FROM low WHERE system = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.sample_id = low.sample_id AND a.n = low.n) GROUP BY sample_id, n) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY i) <= 3)
    SELECT sample_id, array_to_string(list(md5(n) ORDER BY s, i), ',') AS neg FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY sample_id"""
)
def system_negatives(spark, folder):
    """Negatives well below the worst positive from two systems, which give the negatives at odd and at even places."""
    rows = table(spark, folder, "train_data_minedhn").dropDuplicates(["sample_id"]).where("size(pos_scores) > 0")
    scored = F.transform(F.col("neg"), lambda n, i: F.struct(n.alias("pid"), F.get("neg_scores", i).cast("float").alias("ce_score"), (i % 2).alias("s")))
    of = lambda s: F.transform(F.filter("_n", lambda x: x["pid"].isNotNull() & x["ce_score"].isNotNull() & (x["s"] == s)), lambda x: F.struct(x["pid"], x["ce_score"]))
    shaped = rows.withColumn("_n", F.coalesce(scored, F.array().cast("array<struct<pid:string,ce_score:float,s:int>>"))).select(
        F.col("sample_id").alias("qid"), F.transform("pos_scores", lambda s: F.struct(F.lit("").alias("pid"), s.alias("ce_score"))).alias("pos"), F.create_map(F.lit("z"), of(0), F.lit("a"), of(1)).alias("neg")
    )
    found = negatives.margin_negatives(shaped, F.lit(0.2).cast("float"), 3).where("size(neg) > 0")
    return found.select(F.col("qid").alias("sample_id"), F.array_join(F.transform("neg", lambda n: F.md5(n)), ",").alias("neg"))


_RING = f"""size AS (SELECT greatest(1, count(*) // 40) AS cells FROM embeddings), c AS (SELECT vec_id AS pid, floor({drawn_sql(42, "vec_id")} * cells) AS cell FROM embeddings, size), q AS (SELECT vec_id AS qid, floor({drawn_sql(43, "vec_id")} * cells) AS cell, label FROM embeddings, size WHERE vec_id % 100 = 0)"""


@query(
    f"""WITH {_RING}, n AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || ':' || pid || ':42')) AS place FROM q JOIN c USING (cell) WHERE qid <> pid QUALIFY place <= 5)
    SELECT qid, pid, place::INT AS place FROM n"""
)
def topped_up_negatives(spark, folder):
    """Queries that have no negatives yet get five each from the corpus, themselves left out as their only positives."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"))
    none = spark.createDataFrame([], "qid long, pid long, place int")
    own = asked.select("qid", F.col("qid").alias("pid"))
    return negatives.top_up(none, asked, vectors.select(F.col("vec_id").alias("pid")), own, 5)


# -- retrieval ----------------------------------------------------------------------------------------


@query(
    f"""WITH w AS (SELECT doc_id, token, 1.0 / (1 + n) AS weight FROM (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS n
      FROM (SELECT doc_id, w[nth] AS token, nth FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS nth FROM (SELECT doc_id, {Q._WORDS} AS w FROM {Q._DOCS})))))
    SELECT doc_id, token, round(max(weight), 9) AS weight FROM w WHERE token <> 'điều' GROUP BY doc_id, token"""
)
def pooled_tokens(spark, folder):
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.filter(T.tokens(F.col("text")), lambda t: t != "")).alias("at", "token"))
    weights = rows.select("doc_id", "token", (1.0 / (1 + F.col("at"))).alias("weight"))
    return retrieval.pooled_weights(weights, "doc_id", ["điều"]).select("doc_id", "token", F.round("weight", 9).alias("weight"))


@query("SELECT vec_id, round((a * 1 + b * 0.3) / 1.3, 6) AS sparse_dense, round((a * 1 + b * 0.3 + c * 0.5) / 1.8, 6) AS colbert_sparse_dense FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)")
def mixed_pair_scores(spark, folder):
    part = lambda i: F.col("embedding")[i].cast("double")
    pairs = table(spark, folder, "embeddings").select("vec_id", part(0).alias("dense"), part(1).alias("sparse"), part(2).alias("colbert"))
    found = retrieval.mixed_scores(pairs, (1.0, 0.3, 0.5))
    return found.select("vec_id", F.round("sparse_dense", 6).alias("sparse_dense"), F.round("colbert_sparse_dense", 6).alias("colbert_sparse_dense"))


@query(Q.ORACLES["bm25_topk"])
def bm25_from_files(spark, folder):
    """``bm25_topk`` from an index that has been written and read again."""
    path = own_folder(spark, "bm25")
    retrieval.build_bm25(table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id", T.search_terms(F.col("text")), path)
    asked = table(spark, folder, "dev_queries").select("qid", "query").where("query IS NOT NULL").distinct().where(T.id_number(F.col("qid")) % 100 == 0)
    found = retrieval.search_bm25(retrieval.load_bm25(spark, path), asked, "qid", T.search_terms(F.col("query")), k=None)
    found = retrieval.top_k(found.withColumn("_s", F.round("score", 9)).drop("rank"), 100, score="_s")
    return found.select("qid", "pid", F.round("score", 5).alias("score"), "rank")


@query(
    f"""SELECT metric || '@' || k AS name, CASE WHEN metric IN ('accuracy', 'precision', 'recall') THEN printf('%.2f%%', value * 100) ELSE printf('%.4f', value) END AS text FROM ({Q.ORACLES["dense_metrics"]})"""
)
def metric_report(spark, folder):
    return metrics.formatted(Q.dense_metrics(spark, folder))


@query()
def encoded_pairs(spark, folder):
    """Evaluation items against each other's neighbours in all score modes, by the offline encoder."""
    items = table(spark, folder, "eval_items").where("text IS NOT NULL").select("item_id", "text")
    encoded = stage(models.encode_all(items, "item_id", "text", models.hashed_multi_encoder(16)))
    near = retrieval.knn_join(encoded.where("item_id % 100 = 0"), encoded, 10, "item_id", "item_id", "dense")
    side = lambda k, p: encoded.select(F.col("item_id").alias(k), F.col("dense").alias(f"{p}_dense"), F.col("lexical").alias(f"{p}_lexical"), F.col("vectors").alias(f"{p}_vectors"))
    scored = retrieval.pair_scores(near.select("qid", "pid").join(side("qid", "q"), "qid").join(side("pid", "p"), "pid"))
    return scored.select("qid", "pid", "dense", "sparse", "colbert", "sparse_dense", "colbert_sparse_dense")


# -- deduplication with the settings of record ------------------------------------------------------------

BANDS = {0.4: hashing.optimal_bands(0.4, Q.COUNT), 0.7: hashing.optimal_bands(0.7, Q.COUNT)}


def _bands_sql(threshold: float) -> str:
    bands, rows = BANDS[threshold]
    return Q._signatures_sql().replace(f"(i // {Q.ROWS})::INT", f"(i // {rows})::INT").replace("FROM f GROUP BY 1, 2", f"FROM f WHERE i < {bands * rows} GROUP BY 1, 2")


def _labelled_sql(threshold: float, previous: bool, jaccard: float) -> str:
    """Buckets at ``threshold``, then pairs of a bucket cluster above ``jaccard``, as components or first earlier matches."""
    sql = _bands_sql(threshold)
    links = "SELECT b AS x, min(a) AS y FROM pairs GROUP BY b" if previous else "SELECT b AS x, a AS y FROM pairs"
    return f"""WITH RECURSIVE {sql}, {Q._EDGES}, {Q._COMPONENTS}, lab AS (SELECT w.doc_id, coalesce(component, w.doc_id) AS cluster FROM w LEFT JOIN k ON w.doc_id = k.node),
    x AS (SELECT lab.doc_id, cluster, list_distinct(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+ *\\p{{Nd}}*)', 1)) AS s FROM lab JOIN documents USING (doc_id)),
    z AS (SELECT p.doc_id AS a, q.doc_id AS b, len(list_intersect(p.s, q.s))::DOUBLE AS c, len(p.s) AS n, len(q.s) AS m FROM x p JOIN x q ON p.cluster = q.cluster AND p.doc_id < q.doc_id),
    pairs AS (SELECT a, b FROM z WHERE c > 0 AND c / (n + m - c) > {jaccard}), l AS ({links}), g AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
    way(node, reached) AS (SELECT DISTINCT a, a FROM g UNION SELECT way.node, g.b FROM way JOIN g ON way.reached = g.a)
    SELECT lab.doc_id, coalesce(least, lab.doc_id) AS cluster FROM lab LEFT JOIN (SELECT node, min(reached) AS least FROM way GROUP BY node) ON node = doc_id"""


@query(_labelled_sql(0.4, False, 0.52))
def near_dup_full(spark, folder):
    return Q.near_dup_full(spark, folder)


@query(_labelled_sql(0.4, True, 0.52))
def near_dup_previous(spark, folder):
    return Q.near_dup_previous(spark, folder)


@query(
    _labelled_sql(0.7, False, 0.5).replace("documents WHERE text IS NOT NULL", "train AS documents WHERE text IS NOT NULL").replace("JOIN documents", "JOIN train")
    .replace("WITH RECURSIVE ", "WITH RECURSIVE train AS (SELECT sample_id AS doc_id, max(query) AS text FROM train_data GROUP BY sample_id), ")
)
def question_clusters(spark, folder):
    """Second-level clusters over the questions of the training split, all pairs of a bucket cluster compared."""
    rows = table(spark, folder, "train_data").groupBy("sample_id").agg(F.max("query").alias("query"))
    found = dedup.near_dedup(rows, "sample_id", "query", cluster="__cluster_question__", jaccard_threshold=0.5, mode="full", bands=BANDS[0.7])
    return found.select(F.col("sample_id").alias("doc_id"), F.col("__cluster_question__").alias("cluster"))


@query(
    f"""WITH {Q._CLUSTERED}, {{x}}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s))::DOUBLE AS c, len(a.s) AS n, len(b.s) AS m FROM x a JOIN x b ON a.law_id = b.law_id AND a.doc_id < b.doc_id)
    SELECT a, b, round(c / (n + m - c), 6) AS jaccard, round(c / least(n, m), 6) AS containment FROM p WHERE c > 0 AND c / (n + m - c) > 0.6""".replace(f"{Q._CLUSTERED}, ", "").replace(
        "{x}", r"x AS (SELECT doc_id, law_id, list_distinct(regexp_extract_all(text, '([\p{L}\p{N}_]+ *\p{Nd}*)', 1)) AS s FROM documents WHERE text IS NOT NULL AND law_id IS NOT NULL)"
    )
)
def similar_in_law(spark, folder):
    """Pairs of documents of the same law that resemble each other, by both measures."""
    rows = table(spark, folder, "documents").select("doc_id", "law_id", "text").where("text IS NOT NULL AND law_id IS NOT NULL")
    found = setpairs.resembling_pairs(rows, "doc_id", "law_id", T.numbered_words(F.col("text")), 0.6)
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


@query(
    """WITH t(threshold) AS (VALUES (0.4::DOUBLE), (0.7), (0.8)), b AS (SELECT threshold, b, r FROM t, range(1, 251) x(b), range(1, 251) y(r) WHERE b * r <= 250),
    e AS (SELECT threshold, b, r, avg(threshold * (1 - pow(1 - pow(threshold * (i + 0.5) / 400, r), b))) + avg((1 - threshold) * pow(1 - pow(threshold + (1 - threshold) * (i + 0.5) / 400, r), b)) AS err FROM b, range(400) z(i) GROUP BY ALL)
    SELECT threshold, b::INT AS bands, r::INT AS rows FROM e QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY err) = 1"""
)
def band_allocation(spark, folder):
    """Bands and rows for the thresholds in use, by the least area of false positives and negatives."""
    return spark.createDataFrame([(t, *hashing.optimal_bands(t, 250)) for t in (0.4, 0.7, 0.8)], "threshold double, bands int, rows int")


@query(
    f"""WITH RECURSIVE {Q._signatures_sql()}, {Q._EDGES}, {Q._COMPONENTS}, {Q._CENTROID} SELECT threshold, count(DISTINCT CASE WHEN c > 0 AND c / (n + m - c) > threshold THEN parent ELSE doc_id END) AS clusters
    FROM j, (VALUES (0.5::DOUBLE), (0.7), (0.8)) v(threshold) GROUP BY threshold"""
)
def threshold_sweep(spark, folder):
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    clusters = stage(dedup.lsh_clusters(rows, "doc_id", "text", bands=(Q.BANDS, Q.ROWS)))
    return dedup.sweep(rows, "doc_id", "text", clusters, "centroid", [0.5, 0.7, 0.8]).groupBy("threshold").agg(F.countDistinct("cluster").alias("clusters"))


# -- files -----------------------------------------------------------------------------------------------

_CONTENT = "md5(string_agg(md5(item_id || '|' || text), '' ORDER BY item_id)) AS digest"


@query(
    f"""WITH e AS (SELECT item_id, text FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL), a AS (SELECT count(*) AS rows, {_CONTENT} FROM e)
    SELECT layout, rows, digest FROM a, (VALUES ('arrow'), ('buckets'), ('gzip'), ('json'), ('map'), ('parquet'), ('resumed'), ('scores')) v(layout)"""
)
def round_trips(spark, folder):
    """Evaluation items written in every layout and read again."""
    import pyarrow as pa

    base = own_folder(spark, "files")
    items = table(spark, folder, "eval_items").where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    kind = "item_id long, text string"
    sinks.write_table(items, f"{base}/parquet")
    sinks.write_table(items, f"{base}/json", "json")
    items.write.mode("overwrite").option("compression", "gzip").json(f"{base}/gzip")
    sinks.write_buckets(items.withColumn("bucket", training.length_bucket(F.length("text"), [0, 300, 600])), f"{base}/buckets", overwrite=True)
    sinks.write_id_text(items.withColumn("id", F.col("item_id").cast("string")), f"{base}/map")
    sinks.write_in_steps(items.where("item_id % 2 = 0"), f"{base}/resumed", "item_id", lambda d: d, 2)  # interrupted
    sinks.write_in_steps(items, f"{base}/resumed", "item_id", lambda d: d, 3)
    sinks.write_table(items.withColumn("text", F.hex("text")), f"{base}/scores", "csv")
    sink = pa.BufferOutputStream()
    held = items.toArrow()
    with pa.ipc.new_file(sink, held.schema) as writer:
        writer.write_table(held)
    arrow = spark.createDataFrame([(bytearray(sink.getvalue().to_pybytes()),)], "content binary")
    found = {
        "parquet": readers.read_dataset(spark, f"{base}/parquet"), "json": readers.read_dataset(spark, f"{base}/json", "json", kind), "gzip": readers.read_dataset(spark, f"{base}/gzip", "json", kind),
        "buckets": readers.read_dataset(spark, f"{base}/buckets", "json", kind), "map": readers.read_id_text(spark, f"{base}/map").select(F.col("id").cast("long").alias("item_id"), "text"),
        "resumed": readers.read_dataset(spark, f"{base}/resumed"), "scores": readers.read_dataset(spark, f"{base}/scores", "csv", kind).withColumn("text", F.unhex("text").cast("string")),
        "arrow": readers.arrow_rows(arrow, items.schema),
    }
    out = None
    for name, df in found.items():
        digests = F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.md5(F.concat_ws("|", "item_id", "text")).alias("m")))), lambda s: s["m"])
        row = df.agg(F.count("*").alias("rows"), F.md5(F.array_join(digests, "")).alias("digest")).select(F.lit(name).alias("layout"), "rows", "digest")
        out = row if out is None else out.union(row)
    return out


# -- pages -----------------------------------------------------------------------------------------------


def _escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;"))


_ASKED = """page AS (SELECT item_id, any_value(qa_pairs) AS qa FROM qa_items GROUP BY item_id), slot AS (SELECT item_id, qa, unnest(range(1, len(qa) + 1)) AS i FROM page),
    asked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS q, qa[i] AS node FROM slot WHERE qa[i].question IS NOT NULL)"""


@query(
    rf"""WITH {_ASKED}, l AS (SELECT item_id, q, node, unnest(range(1, len(node.rel_docs) + 1)) AS j FROM asked),
    d AS (SELECT item_id, q, j, node.rel_docs[j] AS link FROM l WHERE node.rel_docs[j].title IS NOT NULL AND node.rel_docs[j].href IS NOT NULL)
    SELECT item_id, q, regexp_replace(replace(node.question, chr(10), ' '), '^\s+|\s+$', '', 'g') AS question, count(j) AS links, coalesce(md5(string_agg(split_part(link.href, '&mode', 1), ' ' ORDER BY j)), '') AS hrefs
    FROM asked LEFT JOIN d USING (item_id, q) GROUP BY item_id, q, node.question"""
)
def page_questions(spark, folder):
    """Pages of questions and links written as HTML, with the links of all questions behind each heading, and read again."""
    pages = table(spark, folder, "qa_items").groupBy("item_id").agg(F.any_value("qa_pairs").alias("qa"))
    link = lambda d: F.concat(F.lit("<a href='"), _escaped(d["href"]), F.lit("'>"), _escaped(d["title"]), F.lit("</a>"))
    links = lambda q: F.transform(F.filter(F.coalesce(q["rel_docs"], F.array()), lambda d: d["title"].isNotNull() & d["href"].isNotNull()), link)
    part = lambda q: F.concat(F.lit("<h2>"), _escaped(q["question"]), F.lit("</h2><p>"), F.array_join(links(q), " "), F.lit("</p>"))
    body = F.array_join(F.transform(F.filter("qa", lambda q: q["question"].isNotNull()), part), "\n")
    written = pages.select(F.col("item_id").cast("string").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    found = html.extract_qa(written).select(F.col("url").cast("long").alias("item_id"), F.posexplode("qa_pairs").alias("q", "pair"))
    hrefs = F.transform("pair.rel_docs", lambda d: d["href"])
    joined = F.when(F.size(hrefs) > 0, F.md5(F.array_join(hrefs, " "))).otherwise("")
    return found.select("item_id", (F.col("q") + 1).cast("long").alias("q"), F.col("pair.question").alias("question"), F.size(hrefs).cast("long").alias("links"), joined.alias("hrefs"))


@query(
    r"""SELECT id AS page, so_hieu, nullif(regexp_replace(replace(loai_van_ban, chr(10), ' '), '^\s+|\s+$', '', 'g'), '') AS kind, nullif(regexp_replace(replace(tinh_trang, chr(10), ' '), '^\s+|\s+$', '', 'g'), '') AS status, len(content) AS paragraphs
    FROM laws WHERE len(content) > 0 AND so_hieu IS NOT NULL"""
)
def law_pages(spark, folder):
    """Laws written as pages with a table of metadata and an anchored chapter, and read again."""
    rows = table(spark, folder, "laws").where("size(content) > 0 AND so_hieu IS NOT NULL")
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    empty = F.lit("<td></td>")
    head = F.concat(F.lit("<tr>"), empty, cell(F.col("so_hieu")), empty, empty, cell(F.col("noi_ban_hanh")), F.lit("</tr><tr>"), empty, cell(F.col("loai_van_ban")), F.lit("</tr>"))
    lines = F.array_join(F.transform("content", lambda c: F.concat(F.lit("<p>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</p>"))), "")
    status = F.concat(F.lit("<span class='status'>"), _escaped(F.coalesce("tinh_trang", F.lit(""))), F.lit("</span>"))
    page = F.concat(F.lit("<h1>x</h1><table>"), head, F.lit("</table>"), status, F.lit("<div><p><a name='chuong_1'></a></p>"), lines, F.lit("</div>"))
    found = html.extract_laws(rows.select(F.concat(F.lit("https://x/law-"), "id", F.lit(".aspx")).alias("url"), page.alias("html")))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return found.select(F.col("id").alias("page"), "so_hieu", blank("loai_van_ban").alias("kind"), blank("tinh_trang").alias("status"), (F.size("content") - 1).cast("long").alias("paragraphs"))


@query(
    f"""WITH RECURSIVE {_bands_sql(0.4)}, {Q._EDGES}, {Q._COMPONENTS}, {Q._CENTROID}, member AS (SELECT lab.doc_id, parent, x.s, text FROM lab JOIN x USING (doc_id) JOIN documents USING (doc_id)),
    one AS (SELECT parent, min(doc_id) AS doc_id, any_value(s) AS s, text FROM member GROUP BY parent, text),
    pair AS (SELECT a.parent AS cluster, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s))::DOUBLE AS c, len(a.s) AS n, len(b.s) AS m FROM one a JOIN one b ON a.parent = b.parent AND a.doc_id < b.doc_id)
    SELECT cluster, a, b, round(CASE WHEN c > 0 THEN c / (n + m - c) ELSE 0 END, 6) AS score FROM pair"""
)
def candidate_scores(spark, folder):
    """The score of every pair of different texts of a bucket cluster, as the mode "full" writes them out."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    several = stage(dedup.lsh_clusters(rows, "doc_id", "text", bands=BANDS[0.4]))
    found = dedup.cluster_pairs(rows, "doc_id", "text", several)
    texts = rows.select("doc_id", F.md5("text").alias("m"))
    different = found.join(texts.select(F.col("doc_id").alias("a"), F.col("m").alias("_x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("m").alias("_y")), "b").where("_x <> _y")
    return different.select("cluster", "a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {Q._CLUSTERED} SELECT doc_id, source FROM c WHERE doc_id = cluster")
def cluster_heads(spark, folder):
    return dedup.cluster_roots(Q._text_clusters(spark, folder), "doc_id", "cluster").select("doc_id", "source")


@query(
    """SELECT row_number() OVER (ORDER BY part, place) - 1 AS oid, dataset, place, lang FROM (
    SELECT 0 AS part, item_id AS place, 'eval' AS dataset, lang FROM eval_items UNION ALL SELECT 1, doc_id, 'documents', lang FROM documents)"""
)
def metadata_map(spark, folder):
    """The global number of every row of several sources with the columns it came with."""
    parts = [("eval", table(spark, folder, "eval_items").withColumnRenamed("item_id", "n")), ("documents", table(spark, folder, "documents").withColumnRenamed("doc_id", "n"))]
    return etl.union_with_oids(parts, "text", "n", keep=["n", "lang"]).select("oid", "dataset", F.col("n").alias("place"), "lang")
