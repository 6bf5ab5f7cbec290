"""Queries of the problems tagged llm, and SQL where it can state them."""
from __future__ import annotations

from corpusloom.llm import abuse, bpe, crosssplit, leaks, mixing, nearcopies, pairdefects, textform

QUERIES = {
    "p1_found": nearcopies.p1_found,
    "p1_groups": nearcopies.p1_groups,
    "p2_found": crosssplit.p2_found,
    "p2_report": crosssplit.p2_report,
    "p3_found": textform.p3_found,
    "p3_forms": textform.p3_forms,
    "p4_copies": mixing.p4_copies,
    "p4_shares": mixing.p4_shares,
    "p5_found": pairdefects.p5_found,
    "p5_rates": pairdefects.p5_rates,
    "p7_budget": bpe.p7_budget,
    "p7_documents": bpe.p7_documents,
    "p8_ids": bpe.p8_ids,
    "p9_found": leaks.p9_found,
    "p9_items": leaks.p9_items,
    "p10_found": abuse.p10_found,
    "p10_scores": abuse.p10_scores,
    "p10_rates": abuse.p10_rates,
}


# -- the same in SQL, by other means: every text in consistent form, all words, all pairs that share one ------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(text: str = "text") -> str:
    """The consistent form of a text as an SQL expression."""
    one, gone = textform._ONE, [c for c in textform._GONE if c != "\0"]
    plain = text
    for joined, apart in textform.JOINED.items():
        plain = f"replace({plain}, {_quoted(joined)}, {_quoted(apart)})"
    plain = f"nfc_normalize(translate({plain}, {_quoted(''.join([*one, *gone]))}, {_quoted(''.join(one.values()))}))"
    known = textform._full_look_alikes()
    single = {k: v for k, v in known.items() if len(v) == 1}
    mapped = f"translate(r, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for k, v in known.items():
        if len(v) > 1:
            mapped = f"replace({mapped}, {_quoted(k)}, {_quoted(v)})"
    foreign = r"[\x{370}-\x{3ff}\x{400}-\x{52f}\x{1f00}-\x{1fff}]"
    bare = f"translate(r, {_quoted(''.join(known))}, '')"
    mixed = rf"regexp_matches(r, '{foreign}') AND regexp_full_match({bare}, '[A-Za-z\x{{c0}}-\x{{24f}}\x{{1e00}}-\x{{1eff}}\x{{300}}-\x{{36f}}]+')"
    runs = rf"regexp_extract_all({plain}, '[\p{{L}}\x{{300}}-\x{{36f}}]+|[^\p{{L}}\x{{300}}-\x{{36f}}]+')"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN {mixed} THEN nfc_normalize({mapped}) ELSE r END), '')"


def words_sql(text: str = "text") -> str:
    return rf"regexp_extract_all(lower({form_sql(text)}), '[\p{{L}}\p{{N}}]+')"


_FORMS = " UNION ALL ".join(
    f"SELECT '{name}' AS tbl, {key} AS row_id, {form_sql(text)} AS form FROM (SELECT DISTINCT {key}, {text} FROM {name} WHERE {key} IS NOT NULL AND {text} IS NOT NULL) WHERE {form_sql(text)} <> {text}"
    for name, key, text in textform.FIELDS
)
_NEAR = "common * 20 >= (n + m - common) * 13"
_PAIRS = f"""WITH s AS (SELECT oid, list_distinct({words_sql()}) AS w FROM (SELECT DISTINCT oid, text FROM temp_legal_corpus_withstpvl WHERE oid IS NOT NULL AND text IS NOT NULL)),
    b AS (SELECT oid, len(w) AS n, unnest(w) AS word FROM s WHERE len(w) >= 5),
    p AS (SELECT x.oid AS oid_a, y.oid AS oid_b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS common FROM b x JOIN b y ON x.word = y.word AND x.oid < y.oid AND x.n * 100 >= y.n * 65 AND y.n * 100 >= x.n * 65 GROUP BY 1, 2)"""
_OVERLAPS = f"""WITH e AS (SELECT qid, list_distinct({words_sql("query")}) AS w FROM (SELECT DISTINCT qid, query FROM dev_queries WHERE qid IS NOT NULL AND query IS NOT NULL)),
    t AS (SELECT DISTINCT sample_id, query, pos FROM train_data WHERE sample_id IS NOT NULL),
    u AS (SELECT sample_id, 'query' AS field, query AS text FROM t UNION SELECT sample_id, 'pos', unnest(pos) FROM t), v AS (SELECT *, row_number() OVER () AS nr FROM u WHERE text IS NOT NULL),
    x AS (SELECT qid, len(w) AS n, unnest(w) AS word FROM e), y AS (SELECT sample_id, field, nr, len(w) AS m, unnest(w) AS word FROM (SELECT sample_id, field, nr, list_distinct({words_sql()}) AS w FROM v)),
    p AS (SELECT qid, nr, any_value(sample_id) AS sample_id, any_value(field) AS field, any_value(n) AS n, any_value(m) AS m, count(*) AS common FROM x JOIN y USING (word) GROUP BY qid, nr),
    o AS (SELECT DISTINCT qid, sample_id, field FROM p WHERE {_NEAR})"""
_LEAKS = f"""WITH i AS (SELECT item_id, {words_sql()} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL)),
    d AS (SELECT doc_id, {words_sql()} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    a AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 12), lambda k: array_to_string(w[k:k + 13], ' '))) AS run FROM i WHERE len(w) >= 14),
    b AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 12), lambda k: array_to_string(w[k:k + 13], ' '))) AS run FROM d WHERE len(w) >= 14),
    o AS (SELECT DISTINCT doc_id, item_id FROM b JOIN a USING (run))"""
ORACLES: dict[str, str] = {
    "p1_found": f"{_PAIRS} SELECT oid_a, oid_b FROM p WHERE {_NEAR}",
    "p2_found": f"{_OVERLAPS} SELECT qid, sample_id, field FROM o",
    "p2_report": f"""{_OVERLAPS}, q AS (SELECT DISTINCT qid, split, source FROM dev_queries), c AS (SELECT split, source, count(*) AS queries FROM q GROUP BY 1, 2)
    SELECT split, source, field, any_value(queries) AS queries, count(DISTINCT qid) AS overlapping, count(*) AS pairs FROM o JOIN q USING (qid) JOIN c USING (split, source) GROUP BY 1, 2, 3""",
    "p3_found": f"SELECT tbl, row_id FROM ({_FORMS})",
    "p3_forms": _FORMS,
    "p9_found": f"{_LEAKS} SELECT doc_id, item_id FROM o",
    "p9_items": f"{_LEAKS} SELECT item_id, count(*) AS documents, any_value(split) AS split, any_value(source) AS source FROM o JOIN eval_items USING (item_id) GROUP BY item_id",
}
