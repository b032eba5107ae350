"""The worked graph queries over triples, and the graph operators one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.common import EVENT, GRAPH, N, V, edges, nodes
from tidemark.plans.registry import query
from tidemark.tables import table


def triples(spark, d):
    return G.triples(nodes(spark, d), edges(spark, d))


PROPS = " UNION ALL ".join(f"SELECT id, '{p}', {p}, 'literal', NULL, NULL FROM n WHERE {p} IS NOT NULL" for p in G.PROPERTIES)
T = f"""{GRAPH}, {V}, t(s, p, o_value, o_kind, o_lang, o_datatype) AS (
SELECT id, 'rdf:type', type, 'iri', NULL, NULL FROM n WHERE type IS NOT NULL UNION ALL SELECT id, 'rdfs:label', label, 'literal', NULL, NULL FROM n WHERE label IS NOT NULL UNION ALL {PROPS}
UNION ALL SELECT id, 'no_longer_listed', CASE no_longer_listed WHEN 1 THEN 'true' ELSE 'false' END, 'literal', NULL, 'xsd:boolean' FROM n WHERE no_longer_listed IN (0, 1)
UNION ALL SELECT source, verb, target, 'iri', NULL, NULL FROM e WHERE source IS NOT NULL AND target IS NOT NULL
UNION ALL SELECT inverse, 'owl:inverseOf', verb, 'iri', NULL, NULL FROM v
UNION ALL SELECT verb, 'rdfs:label', replace(verb, '_', ' '), 'literal', 'en', NULL FROM v UNION ALL SELECT verb, 'rdfs:label', replace(pt_verb, '_', ' '), 'literal', 'pt', NULL FROM v
UNION ALL SELECT inverse, 'rdfs:label', replace(inverse, '_', ' '), 'literal', 'en', NULL FROM v UNION ALL SELECT inverse, 'rdfs:label', replace(pt_inverse, '_', ' '), 'literal', 'pt', NULL FROM v)"""


@query("sparql_count_by_type", f"WITH {T} SELECT o_value AS type, count(*) AS nodes FROM t WHERE p = 'rdf:type' GROUP BY o_value")
def count_by_type(spark, d):
    return G.pattern(triples(spark, d), "rdf:type", "n", "type").groupBy("type").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"))


@query("sparql_speakers_orgs", f"WITH {T} SELECT b.o_value AS person, f.o_value AS organisation FROM t a JOIN t b ON b.s = a.s AND b.p = 'rdfs:label' JOIN t c ON c.s = a.s AND c.p = 'listed_under' JOIN t f ON f.s = c.o_value AND f.p = 'rdfs:label' WHERE a.p = 'speaks_at' AND a.o_value = '{EVENT}'")
def speakers_orgs(spark, d):
    t = triples(spark, d)
    at = G.pattern(t, "speaks_at", "p", "ev").where(F.col("ev") == EVENT)
    return at.join(G.pattern(t, "rdfs:label", "p", "person"), "p").join(G.pattern(t, "listed_under", "p", "o"), "p").join(G.pattern(t, "rdfs:label", "o", "organisation"), "o").select("person", "organisation").orderBy("person")


@query(
    "sparql_path_pt",
    f"""WITH {T} SELECT sl.o_value AS sessao, v1.o_value AS v1, el.o_value AS evento, v2.o_value AS v2, pl.o_value AS pessoa FROM t a
JOIN t sl ON sl.s = a.s AND sl.p = 'rdfs:label' JOIN t po ON po.s = a.s AND po.p = 'part_of' JOIN t el ON el.s = po.o_value AND el.p = 'rdfs:label' JOIN t fe ON fe.s = a.s AND fe.p = 'features' JOIN t pl ON pl.s = fe.o_value AND pl.p = 'rdfs:label'
JOIN t v1 ON v1.s = 'part_of' AND v1.p = 'rdfs:label' AND v1.o_lang = 'pt' JOIN t v2 ON v2.s = 'features' AND v2.p = 'rdfs:label' AND v2.o_lang = 'pt'
WHERE a.p = 'rdf:type' AND a.o_value = 'Session' ORDER BY sessao, evento, pessoa LIMIT 6""",
)
def path_pt(spark, d):
    t = triples(spark, d)
    pt = lambda verb, name: G.ontology_triples(spark).where((F.col("s") == verb) & (F.col("p") == "rdfs:label") & (F.col("o_lang") == "pt")).select(F.col("o_value").alias(name))
    s = G.pattern(t, "rdf:type", "s", "ty").where("ty = 'Session'").join(G.pattern(t, "rdfs:label", "s", "sessao"), "s")
    s = s.join(G.pattern(t, "part_of", "s", "ev"), "s").join(G.pattern(t, "rdfs:label", "ev", "evento"), "ev").join(G.pattern(t, "features", "s", "pe"), "s").join(G.pattern(t, "rdfs:label", "pe", "pessoa"), "pe")
    return s.crossJoin(pt("part_of", "v1")).crossJoin(pt("features", "v2")).select("sessao", "v1", "evento", "v2", "pessoa").orderBy("sessao", "evento", "pessoa").limit(6)


@query("sparql_inverse_walk", f"WITH {T} SELECT o_value AS event, count(*) AS speakers FROM t WHERE p = 'speaks_at' GROUP BY o_value")
def inverse_walk(spark, d):
    return G.pattern(triples(spark, d), "speaks_at", "p", "event").groupBy("event").agg(F.count("*").alias("speakers"))


@query("sparql_inverses", f"WITH {T} SELECT b.o_value AS verb, c.o_value AS inverse, x.o_value AS verbo FROM t a JOIN t b ON b.s = a.o_value AND b.p = 'rdfs:label' AND b.o_lang = 'en' JOIN t c ON c.s = a.s AND c.p = 'rdfs:label' AND c.o_lang = 'en' JOIN t x ON x.s = a.o_value AND x.p = 'rdfs:label' AND x.o_lang = 'pt' WHERE a.p = 'owl:inverseOf'")
def inverses(spark, d):
    t = G.ontology_triples(spark)
    label = lambda lang, s, o: G.pattern(t.where(F.col("o_lang") == lang), "rdfs:label", s, o)
    return G.pattern(t, "owl:inverseOf", "i", "v").join(label("en", "v", "verb"), "v").join(label("en", "i", "inverse"), "i").join(label("pt", "v", "verbo"), "v").select("verb", "inverse", "verbo").orderBy("verb")


W = "w AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e WHERE source <> target)"


@query("sparql_two_hops", f"WITH {GRAPH}, {W} SELECT n.type, count(DISTINCT n.id) AS nodes FROM w x JOIN w y ON x.b = y.a JOIN n ON n.id = y.b WHERE x.a = '{EVENT}' GROUP BY n.type")
def two_hops(spark, d):
    reached = G.exactly_two_hops(edges(spark, d), F.col("id") == EVENT)
    return reached.join(nodes(spark, d), "id").groupBy("type").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"))


@query("sparql_stages", f"WITH {T} SELECT st.o_value AS stage, string_agg(se.o_value, ' · ' ORDER BY se.o_value) AS sessions FROM t a JOIN t se ON se.s = a.s AND se.p = 'rdfs:label' JOIN t st ON st.s = a.o_value AND st.p = 'rdfs:label' WHERE a.p = 'on_stage' GROUP BY st.o_value")
def stages(spark, d):
    t = triples(spark, d)
    rows = G.pattern(t, "on_stage", "a", "b").join(G.pattern(t, "rdfs:label", "a", "session"), "a").join(G.pattern(t, "rdfs:label", "b", "stage"), "b")
    return rows.groupBy("stage").agg(F.array_join(F.sort_array(F.collect_list("session")), " · ").alias("sessions"))


@query("sparql_coverage", f"WITH {T} SELECT pu.o_value AS publisher, l.o_value AS title, da.o_value AS published FROM t a JOIN t l ON l.s = a.s AND l.p = 'rdfs:label' JOIN t pu ON pu.s = a.s AND pu.p = 'publisher' LEFT JOIN t da ON da.s = a.s AND da.p = 'date' WHERE a.p = 'rdf:type' AND a.o_value = 'Source'")
def coverage(spark, d):
    t = triples(spark, d)
    c = G.pattern(t, "rdf:type", "c", "ty").where("ty = 'Source'").join(G.pattern(t, "rdfs:label", "c", "title"), "c").join(G.pattern(t, "publisher", "c", "publisher"), "c")
    return c.join(G.pattern(t, "date", "c", "published"), "c", "left").select("publisher", "title", "published").orderBy("published", "publisher")


@query("sparql_no_longer_listed", f"WITH {T} SELECT l.o_value AS person, so.o_value AS source FROM t a JOIN t f ON f.s = a.s AND f.p = 'no_longer_listed' AND f.o_value = 'true' AND f.o_datatype LIKE '%boolean' JOIN t l ON l.s = a.s AND l.p = 'rdfs:label' JOIN t so ON so.s = a.s AND so.p = 'source' WHERE a.p = 'rdf:type' AND a.o_value = 'Person'")
def no_longer_listed(spark, d):
    t = triples(spark, d)
    flag = t.where("p = 'no_longer_listed' AND o_value = 'true' AND o_datatype LIKE '%boolean'").select(F.col("s").alias("x"))
    rows = G.pattern(t, "rdf:type", "x", "ty").where("ty = 'Person'").join(flag, "x").join(G.pattern(t, "rdfs:label", "x", "person"), "x").join(G.pattern(t, "source", "x", "source"), "x")
    return rows.select("person", "source")


@query("sparql_construct_inverses", f"WITH {GRAPH}, {V} SELECT e.target AS s, v.inverse AS p, e.source AS o FROM e JOIN v USING (verb) WHERE e.source IS NOT NULL AND e.target IS NOT NULL")
def construct_inverses(spark, d):
    e = edges(spark, d).where("source IS NOT NULL AND target IS NOT NULL")
    return e.join(G.verbs(spark).select("verb", "inverse"), "verb").select(F.col("target").alias("s"), F.col("inverse").alias("p"), F.col("source").alias("o"))


@query(
    "sparql_same_topic",
    f"""WITH {GRAPH}, po AS (SELECT DISTINCT s.target AS topic, l.target AS org FROM e s JOIN e l ON l.source = s.source AND l.verb = 'listed_under' WHERE s.verb = 'speaks_on')
SELECT tn.label AS topic, a.label AS org_a, b.label AS org_b FROM po x JOIN po y ON x.topic = y.topic AND x.org < y.org JOIN n tn ON tn.id = x.topic JOIN n a ON a.id = x.org JOIN n b ON b.id = y.org ORDER BY topic, org_a, org_b, x.org, y.org LIMIT 40""",
)
def same_topic(spark, d):
    n = nodes(spark, d).select("id", "label")
    e = edges(spark, d)
    po = e.where("verb = 'speaks_on'").select("source", F.col("target").alias("t")).join(e.where("verb = 'listed_under'").select("source", F.col("target").alias("o")), "source").select("t", "o").distinct()
    po = po.join(n.select(F.col("id").alias("t"), F.col("label").alias("topic")), "t").join(n.select(F.col("id").alias("o"), F.col("label").alias("org")), "o")
    pairs = po.alias("a").join(po.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.o") < F.col("b.o")))
    return pairs.select(F.col("a.topic"), F.col("a.org").alias("org_a"), F.col("b.org").alias("org_b"), F.col("a.o").alias("x"), F.col("b.o").alias("y")).orderBy("topic", "org_a", "org_b", "x", "y").limit(40).select("topic", "org_a", "org_b")


@query("sparql_derived_with_pattern", f"WITH {GRAPH} SELECT n.label AS tag, n.type, l.pattern, count(*) AS people FROM e JOIN n ON n.id = e.target JOIN lexicon l ON 'tag:' || l.id = n.id WHERE e.verb IN ('active_in', 'uses', 'advocates', 'offers') GROUP BY ALL ORDER BY people DESC, tag LIMIT 20")
def derived_with_pattern(spark, d):
    e = edges(spark, d).where(F.col("verb").isin("active_in", "uses", "advocates", "offers")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("people"))
    lex = table(spark, d, "lexicon").select(F.concat(F.lit("tag:"), "id").alias("id"), "pattern")
    return e.join(nodes(spark, d), "id").join(lex, "id").select(F.col("label").alias("tag"), "type", "pattern", "people").orderBy(F.desc("people"), "tag").limit(20)


@query("sparql_ask_symmetric", f"WITH {GRAPH} SELECT count(*) > 0 AS answer FROM (SELECT source, verb, target FROM e WHERE source <> target INTERSECT SELECT target, verb, source FROM e)")
def ask_symmetric(spark, d):
    e = edges(spark, d).where("source <> target").select("source", "verb", "target")
    back = e.select(F.col("target").alias("source"), "verb", F.col("source").alias("target"))
    return e.join(back, ["source", "verb", "target"], "left_semi").limit(1).agg((F.count("*") > 0).alias("answer"))


# ---- graph operators by name


@query("gr02_radius", f"WITH RECURSIVE {GRAPH}, {W}, hop AS (SELECT 'topic:fundraising' AS id, 0 AS depth UNION SELECT w.b, hop.depth + 1 FROM hop JOIN w ON w.a = hop.id WHERE hop.depth < 3 AND w.b IS NOT NULL) SELECT id, min(depth) AS depth FROM hop GROUP BY id")
def radius(spark, d):
    return G.within_hops(edges(spark, d), spark.createDataFrame([("topic:fundraising",)], "id string"), 3)


@query("gr04_inverse", f"WITH {GRAPH} SELECT target AS organisation, source AS person FROM e WHERE verb = 'listed_under'")
def inverse(spark, d):
    return edges(spark, d).where("verb = 'listed_under'").select(F.col("target").alias("organisation"), F.col("source").alias("person"))


@query("gr05_alternation", f"WITH {GRAPH} SELECT source, verb, target FROM e WHERE verb IN ('active_in', 'uses', 'advocates', 'offers')")
def alternation(spark, d):
    return edges(spark, d).where(F.col("verb").isin("active_in", "uses", "advocates", "offers")).select("source", "verb", "target")


@query("gr07_labels_pt", f"WITH {V} SELECT e.id, v.pt_verb FROM (SELECT DISTINCT id, verb FROM edges) e JOIN v USING (verb)")
def labels_pt(spark, d):
    return table(spark, d, "edges").select("id", "verb").distinct().join(G.verbs(spark).select("verb", "pt_verb"), "verb").select("id", "pt_verb")


PATTERN_SQL = f"""WITH {GRAPH} SELECT s.id AS n0, e1.verb AS v1, e1.target AS n1, e2.verb AS v2, e2.target AS n2 FROM n s JOIN e e1 ON e1.source = s.id AND e1.verb = 'features' JOIN n p ON p.id = e1.target AND p.type = 'Person'
JOIN e e2 ON e2.source = p.id JOIN n q ON q.id = e2.target AND q.type = 'Topic' WHERE s.type = 'Session' AND s.id <> e2.target"""


def _pattern(spark, d):
    return G.path_pattern(edges(spark, d), nodes(spark, d), F.col("type") == "Session", [("features", "out", F.col("type") == "Person"), (None, "out", F.col("type") == "Topic")])


@query("gr11_path_pattern", PATTERN_SQL)
def path_pattern(spark, d):
    return _pattern(spark, d).select("n0", "v1", "n1", "v2", "n2")


@query("gr12_node_filters", f"WITH {N} SELECT id, CASE WHEN type = 'Person' AND no_longer_listed = 1 THEN 'gone' WHEN type = 'Organisation' AND id IN (SELECT 'org:' || id FROM orgs WHERE placeholder = 1) THEN 'placeholder' ELSE 'type:' || type END AS kind FROM n")
def node_filters(spark, d):
    hold = table(spark, d, "orgs").where("placeholder = 1").select(F.concat(F.lit("org:"), "id").alias("id"), F.lit(True).alias("ph")).distinct()
    kind = F.when((F.col("type") == "Person") & (F.col("no_longer_listed") == 1), "gone").when((F.col("type") == "Organisation") & F.col("ph"), "placeholder").otherwise(F.concat(F.lit("type:"), "type"))
    return nodes(spark, d).join(hold, "id", "left").select("id", kind.alias("kind"))


@query("gr13_shortest_path", f"WITH RECURSIVE {GRAPH}, {W}, hop AS (SELECT 'topic:fundraising' AS id, 0 AS k UNION SELECT w.b, hop.k + 1 FROM hop JOIN w ON w.a = hop.id WHERE hop.k < 4 AND w.b IS NOT NULL) SELECT 'topic:fundraising' AS start, 'stage:quiet-room' AS end, min(k)::INT AS length FROM hop WHERE id = 'stage:quiet-room'")
def shortest_path(spark, d):
    return G.distance(edges(spark, d), "topic:fundraising", "stage:quiet-room")


READ = f"""WITH {GRAPH}, {V} SELECT e.id, replace(replace(v.reads, '{{s}}', a.label), '{{o}}', b.label) AS sentence, replace(replace(v.pt_reads, '{{s}}', a.label), '{{o}}', b.label) AS frase FROM e JOIN v USING (verb) JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target"""


@query("gr14_read_aloud", READ)
def read_aloud(spark, d):
    n = nodes(spark, d).select("id", "label")
    e = edges(spark, d).select(F.col("id").alias("edge"), "verb", "source", "target").join(G.verbs(spark), "verb")
    e = e.join(n.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(n.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    said = lambda t: F.replace(F.replace(F.col(t), F.lit("{s}"), F.col("a")), F.lit("{o}"), F.col("b"))
    return e.select(F.col("edge").alias("id"), said("reads").alias("sentence"), said("pt_reads").alias("frase"))


@query("gr15_sentence_by_ends", f"WITH {GRAPH}, {V} SELECT e.id, v.reads FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target JOIN v ON v.verb = e.verb AND v.domain = a.type AND v.range = b.type")
def sentence_by_ends(spark, d):
    n = nodes(spark, d).select("id", "type")
    e = edges(spark, d).select("id", "verb", "source", "target").join(n.select(F.col("id").alias("source"), F.col("type").alias("domain")), "source").join(n.select(F.col("id").alias("target"), F.col("type").alias("range")), "target")
    return e.join(G.verbs(spark).select("verb", "domain", "range", "reads"), ["verb", "domain", "range"]).select("id", "reads")


@query("gr16_neighbourhood_by_verb", f"WITH {GRAPH}, {V} SELECT id, verb, count(*) AS n FROM (SELECT source AS id, verb FROM e UNION ALL SELECT e.target, v.inverse FROM e JOIN v USING (verb)) WHERE id IS NOT NULL GROUP BY ALL")
def neighbourhood_by_verb(spark, d):
    e = edges(spark, d).join(G.verbs(spark).select("verb", "inverse"), "verb")
    return e.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("verb").alias("verb")), F.struct(F.col("target").alias("id"), F.col("inverse").alias("verb"))))).where("id IS NOT NULL").groupBy("id", "verb").agg(F.count("*").alias("n"))


COLLAPSED = f"""WITH {GRAPH}, g AS (SELECT id FROM n WHERE type = 'Stage') SELECT DISTINCT CASE WHEN source IN (SELECT id FROM g) THEN 'group:stages' ELSE source END AS source, verb, CASE WHEN target IN (SELECT id FROM g) THEN 'group:stages' ELSE target END AS target
FROM e WHERE NOT (coalesce(source IN (SELECT id FROM g), false) AND coalesce(target IN (SELECT id FROM g), false))"""


@query("gr17_collapse", COLLAPSED)
def collapse(spark, d):
    return G.collapse(edges(spark, d), nodes(spark, d).where("type = 'Stage'"), "group:stages")


#: Types of the kinds of tags (fixed values of the lexicon): type of node, verb.
TAG_KINDS = {"Setor": ("Industry", "active_in"), "Tecnologia": ("Technology", "uses"), "Ideia": ("Idea", "advocates"), "Servico": ("Service", "offers"), "Produto": ("Product", "offers")}
SQL_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
#: Blanks around lines, as both engines strip them.
BLANKS = "^[ \t\u00a0]+|[ \t\u00a0]+$"
#: Programme lines of agenda pages: time, title and stage.
SQL_LINES = f"""pr AS (SELECT DISTINCT id AS source, snapshot, regexp_replace(l, '{BLANKS}', '', 'g') AS line FROM (SELECT id, snapshot, unnest(string_split(frozen, chr(10))) AS l FROM sources WHERE page LIKE 'agenda/%' AND frozen IS NOT NULL) WHERE regexp_matches(regexp_replace(l, '{BLANKS}', '', 'g'), '(?s)^[0-9]{{1,2}}:[0-9]{{2}} [—–] .+ \\([^()]+\\)$')),
se AS (SELECT 'session:' || substr(sha256(source || line), 1, 16) AS id, source, snapshot, regexp_extract(line, '(?s)^[0-9:]+ [—–] (.+) \\([^()]+\\)$', 1) AS title, regexp_extract(line, '\\(([^()]+)\\)$', 1) AS stage FROM pr)"""
CASES = lambda k: "CASE type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in TAG_KINDS.items()) + " END"
NODES_SQL = f"""WITH {SQL_LINES}
SELECT DISTINCT id, type, label FROM (
SELECT 'person:' || id AS id, 'Person' AS type, max(name) AS label FROM people WHERE id IS NOT NULL GROUP BY id
UNION ALL SELECT 'org:' || min(id), 'Organisation', name FROM orgs WHERE name IS NOT NULL GROUP BY name HAVING min(id) IS NOT NULL
UNION ALL SELECT 'topic:' || {SQL_SLUG.format('topic')}, 'Topic', min(topic) FROM person_topics WHERE topic IS NOT NULL GROUP BY {SQL_SLUG.format('topic')}
UNION ALL SELECT 'tag:' || id, {CASES(0)}, label FROM lexicon
UNION ALL SELECT 'snapshot:' || snapshot, 'Snapshot', snapshot FROM sources WHERE snapshot IS NOT NULL
UNION ALL SELECT 'source:' || id, 'Source', max(page) FROM sources WHERE id IS NOT NULL GROUP BY id
UNION ALL SELECT 'publisher:' || {SQL_SLUG.format('publisher')}, 'Publisher', min(publisher) FROM sources WHERE publisher IS NOT NULL GROUP BY {SQL_SLUG.format('publisher')}
UNION ALL SELECT '{EVENT}', 'Event', 'Cimeira Maré Alta'
UNION ALL SELECT id, 'Session', title FROM se
UNION ALL SELECT 'stage:' || {SQL_SLUG.format('stage')}, 'Stage', min(stage) FROM se GROUP BY {SQL_SLUG.format('stage')})"""
BUILD_SQL = f"""WITH {SQL_LINES}, cap AS (SELECT DISTINCT snapshot FROM people WHERE snapshot IS NOT NULL), ever AS (SELECT id, min(snapshot) AS f FROM people WHERE id IS NOT NULL GROUP BY id), listed AS (SELECT DISTINCT id, snapshot FROM people WHERE id IS NOT NULL AND snapshot IS NOT NULL),
x AS (
SELECT 'listed_under' AS verb, 'person:' || p.id AS source, 'org:' || o.id AS target FROM people p JOIN (SELECT name, min(id) AS id FROM orgs WHERE name IS NOT NULL GROUP BY name) o ON o.name = p.org WHERE p.id IS NOT NULL AND o.id IS NOT NULL
UNION ALL SELECT 'speaks_on', 'person:' || person, 'topic:' || {SQL_SLUG.format('topic')} FROM person_topics WHERE person IS NOT NULL AND topic IS NOT NULL
UNION ALL SELECT {CASES(1)}, 'person:' || person, 'tag:' || tag FROM person_tags WHERE tag IS NOT NULL AND type IN ({', '.join(repr(k) for k in TAG_KINDS)}) AND person IS NOT NULL
UNION ALL SELECT 'present_in', 'person:' || id, 'snapshot:' || snapshot FROM listed
UNION ALL SELECT 'absent_from', 'person:' || e.id, 'snapshot:' || c.snapshot FROM ever e JOIN cap c ON c.snapshot > e.f WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.id = e.id AND l.snapshot = c.snapshot)
UNION ALL SELECT 'attested_by', 'person:' || l.id, 'source:' || s.id FROM listed l JOIN sources s ON s.snapshot = l.snapshot AND s.page IN ('speakers', 'speakers/' || l.id)
UNION ALL SELECT 'speaks_at', 'person:' || id, '{EVENT}' FROM people WHERE id IS NOT NULL
UNION ALL SELECT 'captured_in', 'source:' || id, 'snapshot:' || snapshot FROM sources WHERE id IS NOT NULL AND snapshot IS NOT NULL
UNION ALL SELECT 'published_by', 'source:' || id, 'publisher:' || {SQL_SLUG.format('publisher')} FROM sources WHERE id IS NOT NULL AND publisher IS NOT NULL
UNION ALL SELECT 'part_of', id, '{EVENT}' FROM se
UNION ALL SELECT 'attested_by', id, 'source:' || source FROM se
UNION ALL SELECT 'on_stage', id, 'stage:' || {SQL_SLUG.format('stage')} FROM se
UNION ALL SELECT 'features', se.id, 'person:' || p.id FROM se JOIN (SELECT DISTINCT id, name FROM people WHERE id IS NOT NULL AND name IS NOT NULL) p ON starts_with(se.title, p.name || ' '))
SELECT DISTINCT verb || ':' || source || ':' || target AS id, verb, source, target FROM x"""


def slugged(x):
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def programme(spark, d):
    """(id, source, snapshot, title, stage): sessions as the agenda pages list them."""
    pattern = r"(?s)^([0-9]{1,2}:[0-9]{2}) [—–] (.+) \(([^()]+)\)$"
    lines = table(spark, d, "sources").where("page LIKE 'agenda/%' AND frozen IS NOT NULL").select(F.col("id").alias("source"), "snapshot", F.explode(F.split("frozen", "\n", -1)).alias("line")).withColumn("line", F.regexp_replace("line", BLANKS, "")).where(F.col("line").rlike(pattern)).distinct()
    return lines.select(F.concat(F.lit("session:"), F.substring(F.sha2(F.concat("source", "line"), 256), 1, 16)).alias("id"), "source", "snapshot", F.regexp_extract("line", pattern, 2).alias("title"), F.regexp_extract("line", pattern, 3).alias("stage"))


@query("gr18_nodes", NODES_SQL)
def build_nodes(spark, d):
    """Nodes derived from the tables, one SELECT per type."""
    one = lambda df, prefix, key, kind, label: df.select(F.concat(F.lit(prefix), key).alias("id"), kind.alias("type"), label.alias("label"))
    p, s, se = table(spark, d, "people").where("id IS NOT NULL"), table(spark, d, "sources"), programme(spark, d)
    of = F.create_map(*[F.lit(x) for k, v in TAG_KINDS.items() for x in (k, v[0])])
    named = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(slugged(F.col(c)).alias("k")).agg(F.min(c).alias("v"))
    k, v = F.col("k"), F.col("v")
    parts = [
        one(p.groupBy(F.col("id").alias("k")).agg(F.max("name").alias("v")), "person:", k, F.lit("Person"), v),
        one(table(spark, d, "orgs").where("name IS NOT NULL").groupBy(F.col("name").alias("v")).agg(F.min("id").alias("k")).where("k IS NOT NULL"), "org:", k, F.lit("Organisation"), v),
        one(named(table(spark, d, "person_topics"), "topic"), "topic:", k, F.lit("Topic"), v),
        one(table(spark, d, "lexicon"), "tag:", F.col("id"), F.try_element_at(of, F.col("type")), F.col("label")),
        one(s.where("snapshot IS NOT NULL").select("snapshot").distinct(), "snapshot:", F.col("snapshot"), F.lit("Snapshot"), F.col("snapshot")),
        one(s.where("id IS NOT NULL").groupBy(F.col("id").alias("k")).agg(F.max("page").alias("v")), "source:", k, F.lit("Source"), v),
        one(named(s, "publisher"), "publisher:", k, F.lit("Publisher"), v),
        one(spark.range(1), EVENT, F.lit(""), F.lit("Event"), F.lit("Cimeira Maré Alta")),
        one(se, "", F.col("id"), F.lit("Session"), F.col("title")),
        one(named(se, "stage"), "stage:", k, F.lit("Stage"), v),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


@query("gr18_build", BUILD_SQL)
def build(spark, d):
    """Edges derived from the tables, one SELECT per rule, each distinct.

    Who speaks in a session is told by the beginning of its title: its
    first words, however many, meet the names of persons by equality.
    """
    people, s, se = table(spark, d, "people"), table(spark, d, "sources"), programme(spark, d)
    p = people.where("id IS NOT NULL")
    org = table(spark, d, "orgs").where("name IS NOT NULL").groupBy(F.col("name").alias("org")).agg(F.min("id").alias("oid")).where("oid IS NOT NULL")
    listed = p.where("snapshot IS NOT NULL").select("id", "snapshot").distinct()
    captures = F.broadcast(people.where("snapshot IS NOT NULL").select("snapshot").distinct())  # one row per capture
    later = p.groupBy("id").agg(F.min("snapshot").alias("f")).join(captures, F.col("snapshot") > F.col("f")).select("id", "snapshot").join(listed, ["id", "snapshot"], "left_anti")
    edge = lambda df, verb, source, target: df.select(verb.alias("verb"), source.alias("source"), target.alias("target"))
    at = lambda prefix, c: F.concat(F.lit(prefix), c if not isinstance(c, str) else F.col(c))
    pages = s.where("id IS NOT NULL").select(F.col("id").alias("sid"), "snapshot", "page", "publisher").distinct()
    verb = F.try_element_at(F.create_map(*[F.lit(x) for k, v in TAG_KINDS.items() for x in (k, v[1])]), F.col("type"))
    own = pages.where("page LIKE 'speakers/%'").select("sid", "snapshot", F.expr("substring(page, 10)").alias("id"))
    openings = se.where("title LIKE '% %'").select("id", "title", F.explode(F.sequence(F.lit(1), F.size(F.split("title", " ")) - 1)).alias("n")).select("id", F.array_join(F.slice(F.split("title", " "), 1, F.col("n")), " ").alias("name"))
    parts = [
        edge(p.join(org, "org"), F.lit("listed_under"), at("person:", "id"), at("org:", "oid")),
        edge(table(spark, d, "person_topics").where("person IS NOT NULL AND topic IS NOT NULL"), F.lit("speaks_on"), at("person:", "person"), at("topic:", slugged(F.col("topic")))),
        edge(table(spark, d, "person_tags").where("tag IS NOT NULL AND person IS NOT NULL").where(verb.isNotNull()), verb, at("person:", "person"), at("tag:", "tag")),
        edge(listed, F.lit("present_in"), at("person:", "id"), at("snapshot:", "snapshot")),
        edge(later, F.lit("absent_from"), at("person:", "id"), at("snapshot:", "snapshot")),
        edge(listed.join(pages.where("page = 'speakers'").select("sid", "snapshot"), "snapshot"), F.lit("attested_by"), at("person:", "id"), at("source:", "sid")),
        edge(listed.join(own, ["id", "snapshot"]), F.lit("attested_by"), at("person:", "id"), at("source:", "sid")),
        edge(p.select("id").distinct(), F.lit("speaks_at"), at("person:", "id"), F.lit(EVENT)),
        edge(pages.where("snapshot IS NOT NULL"), F.lit("captured_in"), at("source:", "sid"), at("snapshot:", "snapshot")),
        edge(pages.where("publisher IS NOT NULL"), F.lit("published_by"), at("source:", "sid"), at("publisher:", slugged(F.col("publisher")))),
        edge(se, F.lit("part_of"), F.col("id"), F.lit(EVENT)),
        edge(se, F.lit("attested_by"), F.col("id"), at("source:", "source")),
        edge(se, F.lit("on_stage"), F.col("id"), at("stage:", slugged(F.col("stage")))),
        edge(openings.join(p.where("name IS NOT NULL").select(F.col("id").alias("pid"), "name").distinct(), "name"), F.lit("features"), F.col("id"), at("person:", "pid")),
    ]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.distinct().select(F.concat_ws(":", "verb", "source", "target").alias("id"), "verb", "source", "target")


@query("gr20_dangling", f"WITH {GRAPH} SELECT e.id, e.source IS NULL OR e.source NOT IN (SELECT id FROM n) AS bad_source, e.target IS NULL OR e.target NOT IN (SELECT id FROM n) AS bad_target FROM e WHERE e.source IS NULL OR e.target IS NULL OR e.source NOT IN (SELECT id FROM n) OR e.target NOT IN (SELECT id FROM n)")
def dangling(spark, d):
    ids = nodes(spark, d).select("id")
    e = edges(spark, d).select("id", "source", "target")
    known = e.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    return known.select("id", F.col("s").isNull().alias("bad_source"), F.col("t").isNull().alias("bad_target")).where("bad_source OR bad_target")


REDUCED = "trim(regexp_replace(trim(regexp_replace(publisher, '\\s*\\([^()]*\\)\\s*$', '')), '^.*—', ''))"


@query("gr21_publishers", f"SELECT {REDUCED} AS publisher, string_agg(DISTINCT publisher, ' | ' ORDER BY publisher) AS spellings, count(DISTINCT id) AS sources FROM sources WHERE publisher IS NOT NULL GROUP BY 1")
def publishers(spark, d):
    reduced = F.trim(F.regexp_replace(F.trim(F.regexp_replace("publisher", r"\s*\([^()]*\)\s*$", "")), "^.*—", ""))
    s = table(spark, d, "sources").where("publisher IS NOT NULL")
    return s.groupBy(reduced.alias("publisher")).agg(F.array_join(F.sort_array(F.collect_set("publisher")), " | ").alias("spellings"), F.countDistinct("id").alias("sources"))


@query("gr22_event_neighbours", f"WITH {GRAPH} SELECT DISTINCT x.id, n.type FROM (SELECT source AS id FROM e WHERE target = '{EVENT}' UNION SELECT target FROM e WHERE source = '{EVENT}') x JOIN n ON n.id = x.id WHERE n.type NOT IN ('Source', 'Snapshot') ORDER BY x.id LIMIT 8")
def event_neighbours(spark, d):
    near = G.both_ways(edges(spark, d)).where(F.col("id") == EVENT).select(F.col("other").alias("id")).distinct()
    return near.join(nodes(spark, d).select("id", "type"), "id").where("type NOT IN ('Source', 'Snapshot')").orderBy("id").limit(8)


@query("gr23_explore", f"WITH {GRAPH} SELECT n.id, n.label, n.type, e.verb FROM e JOIN n ON n.id = e.target WHERE e.source = '{EVENT}' UNION ALL SELECT n.id, n.label, n.type, e.verb FROM e JOIN n ON n.id = e.source WHERE e.target = '{EVENT}' AND e.source <> e.target")
def explore(spark, d):
    return G.View(nodes(spark, d), edges(spark, d)).explore(EVENT)


@query("gr23_search", f"WITH {GRAPH} SELECT id, type, label FROM n WHERE contains(lower(concat_ws(' ', label, role, org)), 'ventures')")
def search(spark, d):
    return G.View(nodes(spark, d), edges(spark, d)).search("Ventures").select("id", "type", "label")


@query("gr23_get_edges", f"WITH {GRAPH} SELECT id, verb, source, target FROM e WHERE (source = '{EVENT}' OR target = '{EVENT}') AND verb = 'speaks_at'")
def get_edges(spark, d):
    return G.View(nodes(spark, d), edges(spark, d)).get_edges(EVENT, verb="speaks_at").select("id", "verb", "source", "target")


@query("gr23_get_graph", f"WITH {GRAPH}, p AS (SELECT id FROM n WHERE pack = 'people') SELECT e.id FROM e WHERE source IN (SELECT id FROM p) AND target IN (SELECT id FROM p) UNION ALL SELECT id FROM p")
def get_graph(spark, d):
    n, e = G.View(nodes(spark, d), edges(spark, d)).get_graph(pack="people")
    return e.select("id").unionByName(n.select("id"))


@query("gr24_triples", f"WITH {T} SELECT s, p, o_value, o_kind, o_lang, o_datatype FROM t")
def all_triples(spark, d):
    return triples(spark, d)


@query(
    "gr25_one_path",
    f"""WITH {GRAPH}, s AS (SELECT id, label FROM n WHERE type = 'Session' AND url IS NOT NULL AND label IS NOT NULL ORDER BY id LIMIT 1),
p AS (SELECT s.label || ' is part of ' || ev.label || coalesce(', on ' || st.label, '') AS sentence FROM s JOIN e e1 ON e1.source = s.id AND e1.verb = 'part_of' JOIN n ev ON ev.id = e1.target LEFT JOIN e e2 ON e2.source = s.id AND e2.verb = 'on_stage' LEFT JOIN n st ON st.id = e2.target)
SELECT coalesce(min(sentence), 'No session has a page yet') AS sentence FROM p""",
)
def one_path(spark, d):
    """The first session with a page, its event and its stage as a sentence; a fixed one where a leg is missing."""
    n, e = nodes(spark, d), edges(spark, d)
    s = n.where("type = 'Session' AND url IS NOT NULL AND label IS NOT NULL").orderBy("id").limit(1).select("id", F.col("label").alias("s"))
    hop = lambda verb, name: e.where(F.col("verb") == verb).select(F.col("source").alias("id"), F.col("target").alias("t")).join(n.select(F.col("id").alias("t"), F.col("label").alias(name)), "t").drop("t")
    rows = s.join(hop("part_of", "ev"), "id").join(hop("on_stage", "st"), "id", "left")
    told = F.concat("s", F.lit(" is part of "), "ev", F.coalesce(F.concat(F.lit(", on "), "st"), F.lit("")))
    return rows.agg(F.coalesce(F.min(told), F.lit("No session has a page yet")).alias("sentence"))


@query("snk02_n_triples")
def n_triples(spark, d):
    """Lines of the N-Triples writer; the round trip through read_n_triples is tested."""
    return G.n_triples(triples(spark, d), "urn:tidemark:")
