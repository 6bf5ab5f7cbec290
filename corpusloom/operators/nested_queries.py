"""Pages, questions and document links of qa_items as flat tables (problem 6)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.operators.nested import dewey_tables
from corpusloom.session import table


def _tables(spark, folder: str, childless: bool = False) -> dict[str, DataFrame]:
    return dewey_tables(table(spark, folder, "qa_items"), "item_id", "qa_pairs", childless)


def p6_found(spark, folder: str) -> DataFrame:
    """One row per related document; ordinal 0 stands for a question without documents or a page without questions."""
    docs = _tables(spark, folder, childless=True)["qa_pairs.rel_docs"]
    return docs.select("item_id", F.col("label")[0].alias("qa_no"), F.col("label")[1].alias("doc_no"))


def p6_questions(spark, folder: str) -> DataFrame:
    found = _tables(spark, folder)["qa_pairs"]
    return found.select("item_id", F.array_join("label", ".").alias("label"), "question")


def p6_links(spark, folder: str) -> DataFrame:
    """Document links with the label of their question."""
    found = _tables(spark, folder)["qa_pairs.rel_docs"]
    return found.select(
        "item_id", F.array_join("label", ".").alias("label"), F.array_join("parent", ".").alias("parent"), "title", "href"
    )


_PAGES = "WITH page AS (SELECT item_id, any_value(qa_pairs) AS qa FROM qa_items WHERE item_id IS NOT NULL GROUP BY item_id)"
_QUESTIONS = (
    _PAGES
    + """, slot AS (SELECT item_id, unnest(range(1, coalesce(len(qa), 0) + 1)) AS q, qa FROM page),
    question AS (SELECT item_id, q, qa[q] AS node FROM slot WHERE qa[q] IS NOT NULL)"""
)
_LINKS = (
    _QUESTIONS
    + """, doc_slot AS (SELECT item_id, q, unnest(range(1, coalesce(len(node.rel_docs), 0) + 1)) AS d, node FROM question),
    doc AS (SELECT item_id, q, d, node.rel_docs[d] AS link FROM doc_slot WHERE node.rel_docs[d] IS NOT NULL)"""
)

def p6_pages(spark, folder: str) -> DataFrame:
    """The pages themselves, which questions and links hang on."""
    return _tables(spark, folder)[""].select("item_id", "url", F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("crawled_at"))


QUERIES = {"p6_pages": p6_pages, "p6_found": p6_found, "p6_questions": p6_questions, "p6_links": p6_links}
ORACLES = {
    "p6_pages": "SELECT item_id, any_value(url) AS url, strftime(min(crawled_at), '%Y-%m-%d %H:%M:%S') AS crawled_at FROM qa_items WHERE item_id IS NOT NULL GROUP BY item_id",
    "p6_found": _LINKS
    + """ SELECT item_id, q::INT AS qa_no, d::INT AS doc_no FROM doc
    UNION ALL SELECT item_id, q::INT, 0 FROM question
      WHERE NOT EXISTS (SELECT 1 FROM doc WHERE doc.item_id = question.item_id AND doc.q = question.q)
    UNION ALL SELECT item_id, 0, 0 FROM page WHERE NOT EXISTS (SELECT 1 FROM question WHERE question.item_id = page.item_id)""",
    "p6_questions": _QUESTIONS + " SELECT item_id, q::VARCHAR AS label, node.question AS question FROM question",
    "p6_links": _LINKS
    + " SELECT item_id, q || '.' || d AS label, q::VARCHAR AS parent, link.title AS title, link.href AS href FROM doc",
}
