"""Problems 2, 4 and 6: history, orphan references, snapshot changes."""

from __future__ import annotations

from tidemark.operators import history as H
from tidemark.operators import orphans as O
from tidemark.operators import snapshots as S
from tidemark.plans.registry import query
from tidemark.tables import table

#: Captures with ordinal and day, and the row that counts for each person and capture.
WINNERS = """
cap AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) - 1 AS k FROM (SELECT DISTINCT snapshot FROM people WHERE snapshot IS NOT NULL)),
days AS (SELECT snapshot, strftime(make_timestamp(min(epoch_us(retrieved::TIMESTAMPTZ))), '%Y-%m-%d') AS d FROM sources WHERE page = 'speakers' AND state = 'primary' GROUP BY snapshot),
capd AS (SELECT cap.snapshot, k, d FROM cap LEFT JOIN days USING (snapshot)),
win AS (SELECT id, name, role, org, k FROM people JOIN cap USING (snapshot) WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id, snapshot ORDER BY loaded DESC NULLS LAST, name DESC NULLS LAST, role DESC NULLS LAST, org DESC NULLS LAST) = 1)
"""


@query(
    "p2_found",
    f"""WITH {WINNERS},
run AS (SELECT id, role, org, k, k - row_number() OVER (PARTITION BY id, role, org ORDER BY k) AS g FROM win),
ver AS (SELECT id, min(k) AS a, max(k) AS b FROM run GROUP BY id, role, org, g)
SELECT DISTINCT ver.id AS person, f.d AS valid_from, CASE WHEN ver.b = (SELECT max(k) FROM cap) THEN '' ELSE t.d END AS valid_to
FROM ver JOIN capd f ON f.k = ver.a LEFT JOIN capd t ON t.k = ver.b + 1""",
)
def p2_found(spark, d):
    h = H.history(table(spark, d, "people"), table(spark, d, "sources"))
    return h.selectExpr("key AS person", "valid_from", "valid_to")


@query(
    "p2_versions",
    f"""WITH {WINNERS},
run AS (SELECT id, role, org, k, k - row_number() OVER (PARTITION BY id, role, org ORDER BY k) AS g FROM win),
ver AS (SELECT id, role, org, min(k) AS a, max(k) AS b FROM run GROUP BY id, role, org, g)
SELECT ver.id AS person, role, org, f.d AS valid_from, CASE WHEN ver.b = (SELECT max(k) FROM cap) THEN '' ELSE t.d END AS valid_to
FROM ver JOIN capd f ON f.k = ver.a LEFT JOIN capd t ON t.k = ver.b + 1""",
)
def p2_versions(spark, d):
    return H.history(table(spark, d, "people"), table(spark, d, "sources")).withColumnRenamed("key", "person")


ORPHANS = """
e AS (SELECT id, source, target, recorded AS ts FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded NULLS LAST, source NULLS FIRST, target NULLS FIRST) = 1),
n AS (SELECT id, source, recorded AS ts, withdrawn FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded NULLS LAST, source NULLS FIRST, withdrawn NULLS FIRST) = 1),
s AS (SELECT id, make_timestamp(epoch_us(retrieved::TIMESTAMPTZ)) AS ts, state FROM sources QUALIFY row_number() OVER (PARTITION BY id ORDER BY retrieved::TIMESTAMPTZ NULLS LAST, state NULLS FIRST) = 1),
ends AS (SELECT id, 'source' AS field, source AS ref, ts FROM e UNION ALL SELECT id, 'target', target, ts FROM e),
cases AS (
SELECT 'edges' AS tbl, ends.id AS rec, field, ends.ts,
       CASE WHEN n.id IS NULL THEN 'missing' WHEN n.withdrawn <= ends.ts THEN 'deleted' WHEN n.ts > ends.ts THEN 'late' ELSE 'ok' END AS reason
FROM ends LEFT JOIN n ON ends.ref = n.id WHERE ends.ref IS NOT NULL
UNION ALL
SELECT 'nodes', n.id, 'source', n.ts,
       CASE WHEN s.id IS NULL THEN 'missing' WHEN s.state = 'excluded' THEN 'deleted' WHEN s.ts > n.ts THEN 'late' ELSE 'ok' END
FROM n LEFT JOIN s ON n.source = s.id WHERE n.source IS NOT NULL)
"""


@query("p4_found", f"WITH {ORPHANS} SELECT DISTINCT tbl, rec, field, reason FROM cases WHERE reason <> 'ok'")
def p4_found(spark, d):
    open_refs = O.orphans(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "sources"))
    return open_refs.select("tbl", "rec", "field", "reason")


@query("p4_counts", f"WITH {ORPHANS} SELECT tbl, strftime(ts, '%Y-%m') AS month, reason, count(*) AS n FROM cases WHERE reason <> 'ok' GROUP BY ALL")
def p4_counts(spark, d):
    return O.counts(O.orphans(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "sources")))


@query(
    "p6_found",
    f"""WITH {WINNERS},
lastk AS (SELECT max(k) AS m FROM cap),
pairs AS (SELECT a.id AS person, a.k + 1 AS k, a.name AS n0, b.name AS n1, a.role AS r0, b.role AS r1, a.org AS o0, b.org AS o1, b.id IS NULL AS gone
          FROM win a LEFT JOIN win b ON a.id = b.id AND b.k = a.k + 1 WHERE a.k < (SELECT m FROM lastk)),
ch AS (
SELECT k, person, 'removed' AS change FROM pairs WHERE gone
UNION ALL SELECT k, person, 'name' FROM pairs WHERE NOT gone AND n0 IS DISTINCT FROM n1
UNION ALL SELECT k, person, 'role' FROM pairs WHERE NOT gone AND r0 IS DISTINCT FROM r1
UNION ALL SELECT k, person, 'org' FROM pairs WHERE NOT gone AND o0 IS DISTINCT FROM o1
UNION ALL SELECT b.k, b.id, 'added' FROM win b LEFT JOIN win a ON a.id = b.id AND a.k = b.k - 1 WHERE b.k > 0 AND a.id IS NULL),
flag AS (SELECT id, coalesce(no_longer_listed, 0) AS f FROM nodes WHERE type = 'Person' QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded NULLS LAST, coalesce(no_longer_listed, 0)) = 1),
ever AS (SELECT id, max(k) AS k FROM win GROUP BY id)
SELECT cap.snapshot AS to_snapshot, person, change FROM ch JOIN cap USING (k)
UNION ALL SELECT (SELECT snapshot FROM cap ORDER BY k DESC LIMIT 1), ever.id, 'stale_flag' FROM flag JOIN ever ON flag.id = 'person:' || ever.id WHERE (f = 1) <> (ever.k < (SELECT m FROM lastk))""",
)
def p6_found(spark, d):
    return S.snapshot_changes(table(spark, d, "people"), None, table(spark, d, "nodes"))
