"""Queries of the text and name operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import boilerplate, canonical, leakage, names, pairs, spam, tokenize
from tidemark.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


PAIRS = """
i AS (SELECT person AS p, 'topic:' || topic AS item FROM person_topics WHERE person IS NOT NULL AND topic IS NOT NULL
      UNION SELECT person, 'tag:' || tag FROM person_tags WHERE person IS NOT NULL AND tag IS NOT NULL
      UNION SELECT id, 'org:' || org FROM people WHERE id IS NOT NULL AND org <> ''),
m AS (SELECT item, count(*) AS n FROM i GROUP BY item),
t AS (SELECT count(DISTINCT p) AS n FROM i),
ab AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM i a JOIN i b ON a.p = b.p AND a.item < b.item GROUP BY ALL HAVING count(*) >= 4),
r AS (SELECT x AS item_a, y AS item_b, ab.n AS n_ab, ma.n AS n_a, mb.n AS n_b, t.n AS n_baskets FROM ab JOIN m ma ON ma.item = x JOIN m mb ON mb.item = y, t WHERE ab.n * t.n >= 3 * ma.n * mb.n)
"""


@query("p1_found")
def p1_found(spark, d):
    return names.variants(table(spark, d, "orgs"))


@query("p1_entities")
def p1_entities(spark, d):
    """Spellings with the number of spellings of the same organisation."""
    e = names.entities(table(spark, d, "orgs"))
    return e.groupBy("entity").agg(F.count("*").alias("spellings"), F.min("id").alias("first_id"))


def _pairs(spark, d):
    return pairs.co_occurring(table(spark, d, "people"), table(spark, d, "person_topics"), table(spark, d, "person_tags"))


@query("p3_found", f"WITH {PAIRS} SELECT item_a, item_b FROM r")
def p3_found(spark, d):
    return _pairs(spark, d).select("item_a", "item_b")


@query("p3_scores", f"WITH {PAIRS} SELECT item_a, item_b, n_ab, n_a, n_b, n_baskets FROM r")
def p3_scores(spark, d):
    return _pairs(spark, d)


@query("p7_found")
def p7_found(spark, d):
    return canonical.canonical_entries(*(table(spark, d, t) for t in ("people", "nodes", "person_tags", "role_list", "lexicon")))


@query("p8_ids")
def p8_ids(spark, d):
    return tokenize.encode_corpus(table(spark, d, "documents"))


@query("p9_found")
def p9_found(spark, d):
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query("p9_passages")
def p9_passages(spark, d):
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p5_found")
def p5_found(spark, d):
    return boilerplate.main_body(table(spark, d, "sources")).selectExpr("id AS source", "line_no")


@query("p10_found")
def p10_found(spark, d):
    return spam.spam_pages(table(spark, d, "documents")).where("is_spam").select("doc_id").distinct()


@query("p10_hosts")
def p10_hosts(spark, d):
    """Pages and spam pages per host."""
    scored = spam.spam_pages(table(spark, d, "documents"))
    return scored.groupBy("source").agg(F.count("*").alias("pages"), F.count_if("is_spam").alias("spam_pages"))
