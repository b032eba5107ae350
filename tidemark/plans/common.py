"""Views shared by the queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.graph import VERBS, first_delivered
from tidemark.tables import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return first_delivered(table(spark, d, "nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return first_delivered(table(spark, d, "edges"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


#: n and e are the graph after the first delivery of each id, v its verbs.
N = "n AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded) = 1)"
E = "e AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded) = 1)"
V = f"v(verb, inverse, domain, range, reads, pt_reads, pt_verb, pt_inverse) AS (VALUES {_values(VERBS)})"
GRAPH = f"{N}, {E}"
EVENT = "event:cimeira-mare-alta"
