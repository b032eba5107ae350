"""Projections, joins, aggregates, windows, sorts and set operations, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators.phrases import mentions
from tidemark.operators.skew import salted_join
from tidemark.plans.common import E, GRAPH, N, V, edges, nodes
from tidemark.plans.registry import query
from tidemark.tables import table as t

c = F.col

# ---- projections and predicates
query("prj01_alias", "SELECT id AS person, name AS full_name FROM people")(lambda s, d: t(s, d, "people").select(c("id").alias("person"), c("name").alias("full_name")))
query("prj02_constant", "SELECT id, 'card' AS origin FROM people")(lambda s, d: t(s, d, "people").select("id", F.lit("card").alias("origin")))
query("prj03_dotted_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: t(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")))
query("prj04_predicate", f"WITH {N} SELECT id, label FROM n WHERE type = 'Person' AND no_longer_listed = 1 AND label <> ''")(lambda s, d: nodes(s, d).where("type = 'Person' AND no_longer_listed = 1 AND label <> ''").select("id", "label"))
query("prj05_in_list", "SELECT id, verb FROM edges WHERE verb IN ('absent_from', 'present_in')")(lambda s, d: t(s, d, "edges").where(c("verb").isin("absent_from", "present_in")).select("id", "verb"))
query("prj06_nulls", "SELECT id, role IS NULL AS no_role FROM people WHERE org IS NOT NULL")(lambda s, d: t(s, d, "people").where("org IS NOT NULL").select("id", c("role").isNull().alias("no_role")))
query("prj07_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")(
    lambda s, d: t(s, d, "orders").select("o_orderkey", F.when(c("o_totalprice") > 200000, "large").when(c("o_totalprice") > 100000, "middle").otherwise("small").alias("size"))
)
VIEW = f"{N}, vis AS (SELECT * FROM n WHERE pack IN ('people', 'orgs', 'topics', 'core') AND type IN ('Person', 'Organisation', 'Topic') AND contains(lower(concat_ws(' ', label, role, org, type)), 'ventures'))"


def visible(s, d):
    """Nodes of the packs and types that are on, by a case-insensitive part of their texts."""
    on = c("pack").isin("people", "orgs", "topics", "core") & c("type").isin("Person", "Organisation", "Topic")
    return nodes(s, d).where(on & F.lower(F.concat_ws(" ", "label", "role", "org", "type")).contains("ventures"))


query("prj08_view_filter", f"WITH {VIEW} SELECT id, label FROM vis")(lambda s, d: visible(s, d).select("id", "label"))


@query("prj09_induced_edges", f"WITH {VIEW}, {E} SELECT e.id FROM e WHERE e.verb <> 'present_in' AND e.source IN (SELECT id FROM vis) AND e.target IN (SELECT id FROM vis)")
def induced_edges(s, d):
    v = visible(s, d)
    e = edges(s, d).where("verb <> 'present_in'")
    return e.join(v.select(c("id").alias("source")), "source", "left_semi").join(v.select(c("id").alias("target")), "target", "left_semi").select("id")


query("prj10_attribute_filter", f"WITH {E} SELECT id FROM e WHERE verb = 'features'")(lambda s, d: edges(s, d).where("verb = 'features'").select("id"))
query("prj11_substring_search", f"WITH {N} SELECT id FROM n WHERE contains(lower(concat_ws(' ', label, role, org)), 'energia')")(lambda s, d: nodes(s, d).where(F.lower(F.concat_ws(" ", "label", "role", "org")).contains("energia")).select("id"))
query("prj12_document_filter", "SELECT DISTINCT id FROM sources WHERE contains(lower(page), 'arquivo') OR contains(lower(publisher), 'press')")(lambda s, d: t(s, d, "sources").where("contains(lower(page), 'arquivo') OR contains(lower(publisher), 'press')").select("id").distinct())
CONTACT = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"), ("phone", r"\+?[0-9]{2,3}[ .-][0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}"), ("postal", r"\b[0-9]{4}-[0-9]{3}\b"), ("link", "https?://")]


@query("prj13_field_drop", "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in CONTACT) + " END AS kind FROM documents) WHERE kind IS NOT NULL")
def field_drop(s, d):
    """Which texts hold contact details; the first kind wins and the field is dropped by the caller."""
    kind = F.when(F.lit(False), "")
    for k, p in CONTACT:
        kind = kind.when(c("text").rlike(p), k)
    return t(s, d, "documents").select("doc_id", kind.alias("kind")).where("kind IS NOT NULL")


query("prj14_whitelist", "SELECT DISTINCT id, regexp_full_match(id, '[a-z0-9._-]+') AS ok FROM orgs")(lambda s, d: t(s, d, "orgs").select("id", c("id").rlike("^[a-z0-9._-]+$").alias("ok")).distinct())


@query("prj15_state_rank", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'needs you' WHEN o_orderpriority LIKE '% %' AND o_orderstatus = 'O' THEN 'blocked with reason' WHEN o_orderstatus = 'O' THEN 'blocked on id' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state FROM orders")
def state_rank(s, d):
    o = c("o_orderstatus") == "O"
    return t(s, d, "orders").select("o_orderkey", F.when(o & c("o_orderpriority").startswith("1"), "needs you").when(o & c("o_orderpriority").contains(" "), "blocked with reason").when(o, "blocked on id").when(c("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))


# ---- joins
query("jn01_inner", "SELECT t.person, t.tag, l.label FROM person_tags t JOIN lexicon l ON l.id = t.tag")(lambda s, d: t(s, d, "person_tags").join(t(s, d, "lexicon").select(c("id").alias("tag"), "label"), "tag").select("person", "tag", "label"))


@query("jn02_star", "SELECT n_name, s_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def star(s, d):
    pre = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("r"))
    j = pre.join(t(s, d, "supplier"), c("s_suppkey") == c("l_suppkey")).join(t(s, d, "nation"), c("n_nationkey") == c("s_nationkey"))
    return j.groupBy("n_name", "s_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query("jn03_path", "SELECT o.o_orderkey, c_name, n_name, r_name FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def path(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), c("c_custkey") == c("o_custkey")).join(t(s, d, "nation"), c("n_nationkey") == c("c_nationkey")).join(t(s, d, "region"), c("r_regionkey") == c("n_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


query("jn04_or_join", f"WITH {GRAPH} SELECT n.id, count(*) AS degree FROM n JOIN e ON e.source = n.id OR e.target = n.id GROUP BY n.id")(lambda s, d: salted_join(G.degree(edges(s, d)), nodes(s, d).select("id"), ["id"], "inner"))


@query("jn05_self_inequality", "SELECT a.topic AS topic_a, b.topic AS topic_b, count(DISTINCT a.person) AS people FROM person_topics a JOIN person_topics b ON a.person = b.person AND a.topic < b.topic GROUP BY ALL")
def self_inequality(s, d):
    p = t(s, d, "person_topics").select("person", "topic").where("topic IS NOT NULL").distinct()
    return p.alias("a").join(p.alias("b"), (c("a.person") == c("b.person")) & (c("a.topic") < c("b.topic"))).groupBy(c("a.topic").alias("topic_a"), c("b.topic").alias("topic_b")).agg(F.count("*").alias("people"))


query("jn06_inequality", "SELECT count(*) AS n FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey WHERE s.s_name <> c.c_name")(lambda s, d: t(s, d, "supplier").join(t(s, d, "customer"), (c("s_nationkey") == c("c_nationkey")) & (c("s_name") != c("c_name"))).agg(F.count("*").alias("n")))
query("jn07_not_in", "SELECT DISTINCT id FROM people WHERE org NOT IN (SELECT name FROM orgs WHERE placeholder = 1 AND name IS NOT NULL)")(
    lambda s, d: t(s, d, "people").where("org IS NOT NULL").join(t(s, d, "orgs").where("placeholder = 1 AND name IS NOT NULL").select(c("name").alias("org")), "org", "left_anti").select("id").distinct()
)


@query("jn08_correlated_not_in", "SELECT r_name, n_name FROM region, nation WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN nation x ON x.n_nationkey = s_nationkey WHERE x.n_regionkey = r_regionkey AND s_nationkey = nation.n_nationkey)")
def correlated_not_in(s, d):
    """Every (region, nation) without a supplier, as a product of two fixed lists and an anti-join."""
    have = t(s, d, "supplier").join(t(s, d, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("r_regionkey"), "n_nationkey").distinct()
    return t(s, d, "region").crossJoin(t(s, d, "nation")).join(have, ["r_regionkey", "n_nationkey"], "left_anti").select("r_name", "n_name")


query("jn09_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey").join(t(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top")), "c_custkey", "left"))
query("jn10_semi", "SELECT DISTINCT id FROM people WHERE id IN (SELECT person FROM person_topics)")(lambda s, d: t(s, d, "people").join(t(s, d, "person_topics").select(c("person").alias("id")), "id", "left_semi").select("id").distinct())
query("jn11_optional", "SELECT p.id, t.topic FROM (SELECT DISTINCT id FROM people WHERE id IS NOT NULL) p LEFT JOIN person_topics t ON t.person = p.id")(lambda s, d: t(s, d, "people").where("id IS NOT NULL").select("id").distinct().join(t(s, d, "person_topics").select(c("person").alias("id"), "topic"), "id", "left"))
query("jn12_default", "SELECT t.person, t.matched, coalesce(l.label, '?') AS label FROM person_tags t LEFT JOIN lexicon l ON l.id = t.tag")(lambda s, d: t(s, d, "person_tags").join(t(s, d, "lexicon").select(c("id").alias("tag"), "label"), "tag", "left").select("person", "matched", F.coalesce("label", F.lit("?")).alias("label")))


@query("jn13_reuse_by_label", f"WITH {N}, known AS (SELECT label, min(id) AS id FROM n WHERE type IN ('Event', 'Organisation') GROUP BY label) SELECT DISTINCT p.org, coalesce(k.id, 'org:new') AS node FROM people p LEFT JOIN known k ON k.label = p.org WHERE p.org IS NOT NULL")
def reuse_by_label(s, d):
    known = nodes(s, d).where(c("type").isin("Event", "Organisation")).groupBy(c("label").alias("org")).agg(F.min("id").alias("node"))
    return t(s, d, "people").where("org IS NOT NULL").select("org").distinct().join(known, "org", "left").select("org", F.coalesce("node", F.lit("org:new")).alias("node"))


@query("jn14_by_section", "WITH sec AS (SELECT section, list(DISTINCT kind) FILTER (kind IS NOT NULL) AS kinds FROM documents WHERE section IS NOT NULL GROUP BY section) SELECT d.doc_id, s.section FROM documents d JOIN sec s ON list_contains(s.kinds, d.kind)")
def by_section(s, d):
    sec = t(s, d, "documents").where("section IS NOT NULL").groupBy("section").agg(F.collect_set("kind").alias("kinds")).select("section", F.explode("kinds").alias("kind"))
    return t(s, d, "documents").select("doc_id", "kind").join(sec, "kind").select("doc_id", "section")


LEX = "replace(replace(l.pattern, '\\b', ''), '\\w', '[a-z]')"


@query("jn15_lexicon", f"SELECT DISTINCT t.matched, l.id AS tag FROM person_tags t, lexicon l WHERE t.matched IS NOT NULL AND regexp_matches(lower(t.matched), lower({LEX}))")
def lexicon_join(s, d):
    """Every distinct text against every pattern; the patterns are a fixed list of a few dozen."""
    lex = t(s, d, "lexicon").select(c("id").alias("tag"), F.lower(F.replace(F.replace("pattern", F.lit("\\b"), F.lit("")), F.lit("\\w"), F.lit("[a-z]"))).alias("p"))
    m = t(s, d, "person_tags").where("matched IS NOT NULL").select("matched").distinct()
    return m.crossJoin(lex).where(F.regexp_like(F.lower("matched"), c("p"))).select("matched", "tag")


@query("jn16_substring", "SELECT l.id AS tag, sum((length(lower(d.text)) - length(replace(lower(d.text), lower(l.label), ''))) // length(l.label))::BIGINT AS occurrences, count(*) AS docs FROM lexicon l JOIN documents d ON contains(lower(d.text), lower(l.label)) GROUP BY l.id")
def substring_join(s, d):
    """All labels in one automaton, so the texts are scanned once whatever their number."""
    texts = t(s, d, "documents").select(c("doc_id").alias("key"), F.lower("text").alias("text"))
    found = mentions(texts, t(s, d, "lexicon").select(c("id").alias("name"), F.lower("label").alias("phrase")))
    return found.groupBy(c("name").alias("tag")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("docs"))


@query("jn17_full_outer", "SELECT coalesce(a.id, b.person) AS id, CASE WHEN a.id IS NULL THEN 'tags only' WHEN b.person IS NULL THEN 'people only' ELSE 'both' END AS side FROM (SELECT DISTINCT id FROM people WHERE id IS NOT NULL) a FULL JOIN (SELECT DISTINCT person FROM person_tags WHERE person IS NOT NULL) b ON a.id = b.person")
def full_outer(s, d):
    a, b = t(s, d, "people").where("id IS NOT NULL").select("id", F.lit(1).alias("a")).distinct(), t(s, d, "person_tags").where("person IS NOT NULL").select(c("person").alias("id"), F.lit(1).alias("b")).distinct()
    return a.join(b, "id", "full_outer").select("id", F.when(c("a").isNull(), "tags only").when(c("b").isNull(), "people only").otherwise("both").alias("side"))


query("jn18_shared_variable", f"WITH {GRAPH} SELECT DISTINCT x.target AS topic, count(*) AS pairs FROM e x JOIN e y ON x.target = y.target AND x.source < y.source WHERE x.verb = 'uses' AND y.verb = 'uses' GROUP BY x.target")(
    lambda s, d: (lambda e: e.alias("x").join(e.alias("y"), (c("x.target") == c("y.target")) & (c("x.source") < c("y.source"))).groupBy(c("x.target").alias("topic")).agg(F.count("*").alias("pairs")))(edges(s, d).where("verb = 'uses'").select("source", "target"))
)
query("jn19_lookup", f"WITH {GRAPH} SELECT s.id, st.label AS stage FROM n s LEFT JOIN (SELECT source, min(target) AS target FROM e WHERE verb = 'on_stage' GROUP BY source) o ON o.source = s.id LEFT JOIN n st ON st.id = o.target WHERE s.type = 'Session'")(
    lambda s, d: nodes(s, d).where("type = 'Session'").select("id").join(edges(s, d).where("verb = 'on_stage'").groupBy(c("source").alias("id")).agg(F.min("target").alias("x")), "id", "left").join(nodes(s, d).select(c("id").alias("x"), c("label").alias("stage")), "x", "left").select("id", "stage")
)
query("jn20_fallback", "SELECT entry, coalesce(nullif(short, ''), label) AS shown FROM role_list")(lambda s, d: t(s, d, "role_list").select("entry", F.coalesce(F.nullif("short", F.lit("")), "label").alias("shown")))

# ---- aggregates
query("ag01_count", "SELECT verb, count(*) AS n FROM edges GROUP BY verb")(lambda s, d: t(s, d, "edges").groupBy("verb").agg(F.count("*").alias("n")).orderBy(F.desc("n")))
query("ag02_count_distinct", "SELECT snapshot, count(DISTINCT id) AS people FROM people GROUP BY snapshot")(lambda s, d: t(s, d, "people").groupBy("snapshot").agg(F.countDistinct("id").alias("people")))
query("ag03_sum", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY ALL")(lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n")))
query("ag04_having", "SELECT org, count(DISTINCT id) AS n FROM people GROUP BY org HAVING count(DISTINCT id) > 3")(lambda s, d: t(s, d, "people").groupBy("org").agg(F.countDistinct("id").alias("n")).where("n > 3"))
query("ag05_group_concat", "SELECT person, string_agg(topic, ' · ' ORDER BY topic) AS topics FROM person_topics GROUP BY person")(lambda s, d: t(s, d, "person_topics").groupBy("person").agg(F.nullif(F.array_join(F.sort_array(F.collect_list("topic")), " · "), F.lit("")).alias("topics")))
def first_of(df, key, item, k):
    """(key, item, _k): the first k distinct items of each key, ranked before anything is collected."""
    pairs = df.select(key, item).distinct()
    top = pairs.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(c("_k") <= k)
    return top


query("ag06_top12_list", "SELECT topic, array_to_string(list_slice(list_sort(list(DISTINCT person)), 1, 12), ' · ') AS people FROM person_topics WHERE topic IS NOT NULL AND person IS NOT NULL GROUP BY topic")(
    lambda s, d: first_of(t(s, d, "person_topics").where("topic IS NOT NULL AND person IS NOT NULL"), "topic", "person", 12).groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "person"))), lambda x: x["person"]), " · ").alias("people"))
)
query("ag08_dependent_columns", f"WITH {GRAPH} SELECT n.id, n.label, n.type, count(*) AS n FROM n JOIN e ON e.target = n.id GROUP BY n.id, n.label, n.type")(lambda s, d: edges(s, d).groupBy(c("target").alias("id")).agg(F.count("*").alias("n")).join(nodes(s, d).select("id", "label", "type"), "id").select("id", "label", "type", "n"))
query("ag09_three_keys", "SELECT type, tag, matched, count(*) AS n FROM person_tags GROUP BY ALL")(lambda s, d: t(s, d, "person_tags").groupBy("type", "tag", "matched").agg(F.count("*").alias("n")))
query("ag10_conditional", "SELECT snapshot, count(*) FILTER (state = 'primary') AS primary_n, count(*) FILTER (state = 'excluded') AS excluded_n, count(*) AS n FROM sources GROUP BY snapshot")(lambda s, d: t(s, d, "sources").groupBy("snapshot").agg(F.count_if(c("state") == "primary").alias("primary_n"), F.count_if(c("state") == "excluded").alias("excluded_n"), F.count("*").alias("n")))


@query("ag11_nested_count", "SELECT user_id, sum(n)::BIGINT AS total, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_kind FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def nested_count(s, d):
    k = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return k.groupBy("user_id").agg(F.sum("n").alias("total"), F.array_join(F.sort_array(F.collect_list(F.concat("event_type", F.lit("="), "n"))), ",").alias("by_kind"))


STATES = ["primary", "secondary", "excluded"]
query("ag12_matrix", "SELECT publisher, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in STATES) + ", count(*) AS total FROM sources GROUP BY publisher")(lambda s, d: t(s, d, "sources").groupBy("publisher").agg(*[F.count_if(c("state") == x).alias(x) for x in STATES], F.count("*").alias("total")))
query("ag12_pivot", "SELECT section, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("article", "memo", "session")) + " FROM documents GROUP BY section")(lambda s, d: t(s, d, "documents").groupBy("section").pivot("kind", ["article", "memo", "session"]).count().na.fill(0, ["article", "memo", "session"]))


@query("ag13_derived_orgs", "SELECT DISTINCT p.org AS name, p.id AS person, m.members, p.org IN (SELECT name FROM orgs WHERE placeholder = 1) AS placeholder FROM people p JOIN (SELECT org, count(DISTINCT id) AS members FROM people WHERE org <> '' AND id IS NOT NULL GROUP BY org) m ON m.org = p.org WHERE p.org <> '' AND p.id IS NOT NULL")
def derived_orgs(s, d):
    """One row per organisation and member, so that no organisation's members have to fit one row."""
    x = t(s, d, "people").where("org <> '' AND id IS NOT NULL").select(c("org").alias("name"), c("id").alias("person")).distinct()
    hold = t(s, d, "orgs").where("placeholder = 1").select(c("name"), F.lit(True).alias("p")).distinct()
    sizes = x.groupBy("name").agg(F.count("*").alias("members")).join(hold, "name", "left").select("name", "members", F.coalesce("p", F.lit(False)).alias("placeholder"))
    return salted_join(x, sizes, ["name"], "inner").select("name", "person", "members", "placeholder")


query("ag14_topic_index", "SELECT DISTINCT p.topic, p.person, m.n FROM person_topics p JOIN (SELECT topic, count(DISTINCT person) AS n FROM person_topics GROUP BY topic) m ON m.topic = p.topic WHERE p.person IS NOT NULL")(
    lambda s, d: (lambda x: salted_join(x, x.groupBy("topic").agg(F.count("*").alias("n")), ["topic"], "inner").select("topic", "person", "n"))(t(s, d, "person_topics").where("topic IS NOT NULL AND person IS NOT NULL").select("topic", "person").distinct())
)


@query("ag15_resources", "WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([a-z0-9.-]+)', 1)) AS domain FROM documents) SELECT domain, count(*) AS links, count(DISTINCT doc_id) AS docs FROM l WHERE NOT regexp_matches(domain, '(^|\\.)(mare-alta\\.example)$') GROUP BY domain")
def resources(s, d):
    l = t(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("https?://([a-z0-9.-]+)"), F.lit(1))).alias("domain"))
    return l.where(~c("domain").rlike(r"(^|\.)(mare-alta\.example)$")).groupBy("domain").agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("docs"), F.desc("links"), "domain")


query("ag16_degrees", f"WITH {E}, x AS (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM x WHERE id IS NOT NULL GROUP BY id")(lambda s, d: G.in_out_degree(edges(s, d)))
query("ag17_packs", f"WITH {N} SELECT pack, type, count(*) AS n FROM n GROUP BY ALL")(lambda s, d: nodes(s, d).groupBy("pack", "type").agg(F.count("*").alias("n")))
query("ag18_contributors", "WITH u AS (SELECT person, source FROM person_topics UNION ALL SELECT person, source FROM person_tags) SELECT person, count(*) AS steps, count(DISTINCT source) AS sources FROM u GROUP BY person")(lambda s, d: t(s, d, "person_topics").select("person", "source").unionByName(t(s, d, "person_tags").select("person", "source")).groupBy("person").agg(F.count("*").alias("steps"), F.countDistinct("source").alias("sources")))
query("ag19_load", "SELECT n_name, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")(
    lambda s, d: t(s, d, "orders").join(t(s, d, "customer"), c("c_custkey") == c("o_custkey")).join(t(s, d, "nation"), c("n_nationkey") == c("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.count_if(c("o_orderstatus") == "O").alias("open"))
)
query("ag20_boxes", "SELECT o_orderpriority AS box, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY box")(lambda s, d: t(s, d, "orders").groupBy(c("o_orderpriority").alias("box")).agg(*[F.count_if(c("o_orderstatus") == x).alias(x.lower()) for x in "FOP"]))
BOARD = ["view", "click", "purchase"]
query("ag21_board", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view_n, count(*) FILTER (event_type = 'click') AS click_n, count(*) FILTER (event_type = 'purchase') AS purchase_n, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS other_n, count(*) AS n FROM events GROUP BY user_id")(
    lambda s, d: t(s, d, "events").groupBy("user_id").agg(*[F.count_if(c("event_type") == x).alias(f"{x}_n") for x in BOARD], F.count_if(~c("event_type").isin(BOARD)).alias("other_n"), F.count("*").alias("n"))
)


@query("ag22_reverse_index", f"WITH {N}, a AS (SELECT source, count(DISTINCT person) AS topic_people FROM person_topics GROUP BY source), b AS (SELECT source, count(DISTINCT person) AS tag_people FROM person_tags GROUP BY source), x AS (SELECT source, count(*) AS nodes FROM n GROUP BY source) SELECT source, coalesce(topic_people, 0) AS topic_people, coalesce(tag_people, 0) AS tag_people, coalesce(nodes, 0) AS nodes FROM a FULL JOIN b USING (source) FULL JOIN x USING (source) WHERE source IS NOT NULL")
def reverse_index(s, d):
    """One shuffle: the three kinds of use are counted together instead of joined."""
    use = lambda df, kind, who: df.select("source", F.lit(kind).alias("k"), who.alias("who"))
    u = use(t(s, d, "person_topics"), 0, c("person")).unionByName(use(t(s, d, "person_tags"), 1, c("person"))).unionByName(use(nodes(s, d), 2, c("id")))
    return u.where("source IS NOT NULL").distinct().groupBy("source").agg(*[F.count_if((c("k") == i) & c("who").isNotNull()).alias(n) for i, n in enumerate(("topic_people", "tag_people", "nodes"))])


query("ag23_equal_sizes", "SELECT bytes, count(DISTINCT id) AS files FROM sources WHERE bytes IS NOT NULL GROUP BY bytes HAVING count(DISTINCT id) > 1")(lambda s, d: t(s, d, "sources").where("bytes IS NOT NULL").groupBy("bytes").agg(F.countDistinct("id").alias("files")).where("files > 1"))
query("ag24_same_time", "SELECT snapshot, count(DISTINCT retrieved) AS times, count(*) AS files, coalesce(count(DISTINCT retrieved) = 1 AND NOT starts_with(min(retrieved), snapshot), false) AS anomaly FROM sources GROUP BY snapshot")(
    lambda s, d: t(s, d, "sources").groupBy("snapshot").agg(F.countDistinct("retrieved").alias("times"), F.count("*").alias("files"), F.min("retrieved").alias("m")).select("snapshot", "times", "files", F.coalesce((c("times") == 1) & ~F.startswith("m", "snapshot"), F.lit(False)).alias("anomaly"))
)
query("ag25_segments", "SELECT kind, lower(trim(lang)) AS locale, count(*) AS n, count(text) AS done, count(*) - count(text) AS missing, count(*) FILTER (text IS NOT NULL AND source IS NULL) AS orphaned, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY ALL")(
    lambda s, d: t(s, d, "documents").groupBy("kind", F.lower(F.trim("lang")).alias("locale")).agg(F.count("*").alias("n"), F.count("text").alias("done"), F.count_if(c("text").isNull()).alias("missing"), F.count_if(c("text").isNotNull() & c("source").isNull()).alias("orphaned"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
)
query("ag26_frequency", "SELECT sha256(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")(lambda s, d: t(s, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n")))
query("ag27_coverage", "SELECT type, round_even(100.0 * count(tag) / count(*), 1)::DOUBLE AS pct FROM person_tags GROUP BY type")(lambda s, d: t(s, d, "person_tags").groupBy("type").agg(F.bround(F.lit(100.0) * F.count("tag") / F.count("*"), 1).alias("pct")))
query("ag29_summary_check", "SELECT o.id, json_array_length(o.people)::BIGINT AS stored, count(DISTINCT p.id) AS counted, coalesce(json_array_length(o.people)::BIGINT = count(DISTINCT p.id), false) AS agrees FROM (SELECT id, name, max(people) AS people FROM orgs GROUP BY id, name) o LEFT JOIN people p ON p.org = o.name GROUP BY o.id, o.name, o.people")(
    lambda s, d: t(s, d, "orgs").groupBy("id", "name").agg(F.max("people").alias("people")).join(t(s, d, "people").groupBy(c("org").alias("name")).agg(F.countDistinct("id").alias("k")), "name", "left").select("id", F.json_array_length("people").cast("bigint").alias("stored"), F.coalesce("k", F.lit(0)).alias("counted")).withColumn("agrees", F.coalesce(c("stored") == c("counted"), F.lit(False)))
)
query("ag30_stored_count", "SELECT doc_id, n_chars AS stored, length(text) AS counted, coalesce(length(text), n_chars) AS corrected, n_chars IS DISTINCT FROM length(text) AS rewritten FROM documents")(
    lambda s, d: t(s, d, "documents").select("doc_id", c("n_chars").alias("stored"), F.length("text").cast("bigint").alias("counted")).select("*", F.coalesce("counted", "stored").alias("corrected"), (~c("stored").eqNullSafe(c("counted"))).alias("rewritten"))
)
@query("ag31_ratio", "WITH x AS (SELECT person, count(tag) AS confirmed, count(*) AS claims FROM person_tags GROUP BY person) SELECT person, confirmed, claims, confirmed || ' of ' || claims AS ratio, coalesce(person = (SELECT min(person) FROM x WHERE confirmed = 0), false) AS first_zero FROM x")
def ratio(s, d):
    """Ordered by what is confirmed; the first person of whom nothing is, is marked."""
    x = t(s, d, "person_tags").groupBy("person").agg(F.count("tag").alias("confirmed"), F.count("*").alias("claims"))
    none = x.where("confirmed = 0").agg(F.min("person").alias("_p"))
    return x.crossJoin(none).select("person", "confirmed", "claims", F.concat("confirmed", F.lit(" of "), "claims").alias("ratio"), F.coalesce(c("person") == c("_p"), F.lit(False)).alias("first_zero")).orderBy(F.desc("confirmed"), "person")
query("ag32_tags_by_type", "SELECT type, count(*) AS n, count(DISTINCT tag) AS tags FROM person_tags GROUP BY type")(lambda s, d: t(s, d, "person_tags").groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("tags")))


@query("ag33_folder_counts", "WITH p AS (SELECT DISTINCT id FROM sources), x AS (SELECT array_to_string(list_slice(string_split(id, '/'), 1, k), '/') AS prefix FROM p, range(1, 6) r(k) WHERE k < len(string_split(id, '/'))) SELECT prefix, count(*) AS files FROM x GROUP BY prefix")
def folder_counts(s, d):
    parts = F.split("id", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return t(s, d, "sources").select("id").distinct().where(F.size(parts) > 1).select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("files"))


query("ag34_verified_total", "SELECT (SELECT count(*) FROM person_topics) + (SELECT count(*) FROM person_tags) - (SELECT count(*) FROM person_tags WHERE tag IS NULL) AS verified")(
    lambda s, d: t(s, d, "person_topics").select(F.lit(1).alias("v")).unionByName(t(s, d, "person_tags").select(c("tag").isNotNull().cast("int").alias("v"))).agg(F.sum("v").alias("verified"))
)


@query("ag35_section_rollup", "WITH s AS (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL) SELECT s.section, (SELECT count(*) FROM documents d WHERE d.section = s.section) AS docs, (SELECT count(*) FROM documents d WHERE d.section = s.section AND kind = 'article') AS articles, (SELECT count(*) FROM documents d WHERE d.section = s.section AND text IS NOT NULL) > 0 AS has_data FROM s")
def section_rollup(s, d):
    return t(s, d, "documents").where("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("docs"), F.count_if(c("kind") == "article").alias("articles"), (F.count("text") > 0).alias("has_data"))


@query("ag36_stages_summary", f"WITH {GRAPH} SELECT 'files' AS stage, (SELECT count(DISTINCT id) FROM sources) AS value UNION ALL SELECT 'nodes', (SELECT count(*) FROM n) UNION ALL SELECT 'edges', (SELECT count(*) FROM e) UNION ALL SELECT 'tags', (SELECT count(tag) FROM person_tags)")
def stages_summary(s, d):
    one = lambda name, df: df.select(F.lit(name).alias("stage"), c("v").cast("bigint").alias("value"))
    return (
        one("files", t(s, d, "sources").agg(F.countDistinct("id").alias("v")))
        .unionByName(one("nodes", t(s, d, "nodes").agg(F.countDistinct("id").alias("v"))))
        .unionByName(one("edges", t(s, d, "edges").agg(F.countDistinct("id").alias("v"))))
        .unionByName(one("tags", t(s, d, "person_tags").agg(F.count("tag").alias("v"))))
    )


@query("ag37_kanban", "WITH col(k, state) AS (VALUES (1, 'O'), (2, 'P'), (3, 'F'), (4, 'X')) SELECT k, state, count(o_orderkey) AS n FROM col JOIN orders ON o_orderstatus = state GROUP BY k, state")
def kanban(s, d):
    col = s.createDataFrame([(1, "O"), (2, "P"), (3, "F"), (4, "X")], "k int, state string")
    return col.join(t(s, d, "orders").groupBy(c("o_orderstatus").alias("state")).agg(F.count("*").alias("n")), "state").select("k", "state", "n").orderBy("k")


query("ag38_manifest", "SELECT CASE WHEN regexp_matches(id, '^[0-9-]{10}/(press|record)/') THEN snapshot || '/coverage' ELSE snapshot || '/' || string_split(page, '/')[1] END AS folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM sources GROUP BY folder")(
    lambda s, d: t(s, d, "sources").groupBy(F.when(c("id").rlike("^[0-9-]{10}/(press|record)/"), F.concat("snapshot", F.lit("/coverage"))).otherwise(F.concat("snapshot", F.lit("/"), F.element_at(F.split("page", "/"), 1))).alias("folder")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
)
@query("ag39_by_day", f"WITH {GRAPH}, st AS (SELECT e.source AS id, min(b.label) AS stage FROM e JOIN n b ON b.id = e.target WHERE e.verb = 'on_stage' GROUP BY e.source) SELECT n.day, n.id, st.stage FROM n LEFT JOIN st USING (id) WHERE n.type = 'Session'")
def by_day(s, d):
    """Sessions in order of days with the label of their stage, one row each."""
    stage = edges(s, d).where("verb = 'on_stage'").select(c("source").alias("id"), c("target").alias("sid")).join(nodes(s, d).select(c("id").alias("sid"), "label"), "sid").groupBy("id").agg(F.min("label").alias("stage"))
    return nodes(s, d).where("type = 'Session'").select("id", "day").join(stage, "id", "left").select("day", "id", "stage").orderBy("day", "id")

# ---- windows
query("wn01_adjacent", "SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS before FROM (SELECT DISTINCT snapshot FROM people)")(lambda s, d: t(s, d, "people").select("snapshot").distinct().withColumn("before", F.lag("snapshot").over(Window.orderBy("snapshot"))))
query("wn02_sequential_ids", "SELECT person, topic, person || '-c' || lpad(CAST(row_number() OVER (PARTITION BY person ORDER BY topic NULLS FIRST, source NULLS FIRST) AS VARCHAR), 2, '0') AS id FROM person_topics")(
    lambda s, d: t(s, d, "person_topics").select("person", "topic", F.format_string("%s-c%02d", c("person"), F.row_number().over(Window.partitionBy("person").orderBy("topic", "source"))).alias("id"))
)
query("wn03_first_wins", f"WITH {E} SELECT id, verb, source, target, recorded FROM e")(lambda s, d: edges(s, d).select("id", "verb", "source", "target", "recorded"))
query("wn04_last_two_days", "SELECT DISTINCT source, day FROM (SELECT source, strftime(published, '%Y-%m-%d') AS day, dense_rank() OVER (PARTITION BY source ORDER BY strftime(published, '%Y-%m-%d') DESC) AS k FROM documents WHERE published IS NOT NULL) WHERE k <= 2")(
    lambda s, d: t(s, d, "documents").where("published IS NOT NULL").select("source", F.date_format("published", "yyyy-MM-dd").alias("day")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("day")))).where("k <= 2").drop("k")
)
query("wn05_budget", "SELECT doc_id FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars IS NOT NULL) WHERE total <= 5000 OR k = 1")(
    lambda s, d: (lambda w: t(s, d, "documents").where("n_chars IS NOT NULL").select("doc_id", F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(w).alias("k")).where("total <= 5000 OR k = 1").select("doc_id"))(Window.partitionBy("source").orderBy("doc_id"))
)
@query("wn06_first_mention", "WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-zà-ÿ0-9]+') AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w) SELECT p.doc_id, l.id AS entity, min(pos)::INT AS first_pos FROM p JOIN lexicon l ON lower(l.label) = p.word GROUP BY p.doc_id, l.id")
def first_mention(s, d):
    """Position of the first word of a text that names an entry; words meet labels by equality."""
    words = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.lower("text"), "[^a-zà-ÿ0-9]+")).alias("pos", "word"))
    return words.join(t(s, d, "lexicon").select(c("id").alias("entity"), F.lower("label").alias("word")), "word").groupBy("doc_id", "entity").agg(F.min("pos").alias("first_pos"))


@query("wn07_fill_slots", "WITH slot AS (SELECT section, max(doc_id) AS doc_id FROM documents WHERE kind = 'article' AND section IS NOT NULL GROUP BY section), rest AS (SELECT doc_id, section FROM documents WHERE kind = 'article' AND section IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM slot) QUALIFY row_number() OVER (PARTITION BY section ORDER BY published DESC NULLS LAST, doc_id) <= 3) SELECT section, doc_id, 'slot' AS why FROM slot UNION ALL SELECT section, doc_id, 'recent' FROM rest")
def fill_slots(s, d):
    a = t(s, d, "documents").where("kind = 'article' AND section IS NOT NULL").select("doc_id", "section", "published")
    slot = a.groupBy("section").agg(F.max("doc_id").alias("doc_id"))
    rest = a.join(slot.select("doc_id"), "doc_id", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy(F.desc_nulls_last("published"), "doc_id"))).where("k <= 3")
    return slot.select("section", "doc_id", F.lit("slot").alias("why")).unionByName(rest.select("section", "doc_id", F.lit("recent").alias("why")))


VERSION = "struct_pack(a := CAST(split_part(snapshot, '-', 1) AS INT), b := CAST(split_part(snapshot, '-', 2) AS INT), c := CAST(split_part(snapshot, '-', 3) AS INT))"


@query("wn08_monotone", f"SELECT page, max({VERSION}).a || '.' || max({VERSION}).b || '.' || max({VERSION}).c AS newest, count(*) > count(DISTINCT snapshot) AS repeated, max(snapshot) FILTER (state = 'primary') IS NOT DISTINCT FROM max(snapshot) AS current FROM sources GROUP BY page")
def monotone(s, d):
    """The versions of a page as tuples: the newest, whether one comes twice, and whether the primary copy is the newest."""
    version = F.struct(*[F.split_part("snapshot", F.lit("-"), F.lit(i)).cast("int").alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c"))])
    g = t(s, d, "sources").groupBy("page").agg(F.max(version).alias("v"), (F.count("*") > F.countDistinct("snapshot")).alias("repeated"), F.max(F.when(c("state") == "primary", c("snapshot"))).alias("p"), F.max("snapshot").alias("m"))
    return g.select("page", F.concat_ws(".", "v.a", "v.b", "v.c").alias("newest"), "repeated", c("p").eqNullSafe(c("m")).alias("current"))
query("wn09_siblings", "SELECT doc_id, count(*) OVER (PARTITION BY source) - 1 AS siblings FROM documents")(lambda s, d: salted_join(*(lambda x: (x, x.groupBy("source").agg((F.count("*") - 1).alias("siblings"))))(t(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))), ["source"]).select("doc_id", "siblings"))

# ---- sorts and limits
query("so01_mixed_order", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")))
query("so02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))
query("so04_nulls_last", "SELECT id, org FROM people ORDER BY org IS NULL, org, id NULLS LAST, snapshot LIMIT 50")(lambda s, d: t(s, d, "people").orderBy(F.asc_nulls_last("org"), F.asc_nulls_last("id"), "snapshot").limit(50).select("id", "org"))
query("so05_sentinel", f"WITH {N} SELECT id, coalesce(date, '9999') AS key FROM n WHERE type = 'Source'")(lambda s, d: nodes(s, d).where("type = 'Source'").select("id", F.coalesce("date", F.lit("9999")).alias("key")).orderBy("key"))


@query("so06_output_cap", "WITH x AS (SELECT DISTINCT id, name FROM orgs WHERE id IS NOT NULL AND name IS NOT NULL) SELECT id, name, greatest((SELECT count(*) FROM x) - 500, 0) AS not_shown FROM x ORDER BY id, name LIMIT 500")
def output_cap(s, d):
    """The first 500 rows of a report, and how many more it doesn't show."""
    x = t(s, d, "orgs").where("id IS NOT NULL AND name IS NOT NULL").select("id", "name").distinct()
    return x.orderBy("id", "name").limit(500).crossJoin(x.agg(F.greatest(F.count("*") - 500, F.lit(0)).alias("not_shown")))


@query("so07_stated_truncation", "SELECT topic, array_to_string(list_slice(list_sort(list(DISTINCT person)), 1, 5), ',') AS shown, greatest(count(DISTINCT person) - 5, 0) AS cut FROM person_topics WHERE topic IS NOT NULL AND person IS NOT NULL GROUP BY topic")
def stated_truncation(s, d):
    x = t(s, d, "person_topics").where("topic IS NOT NULL AND person IS NOT NULL")
    shown = first_of(x, "topic", "person", 5).groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("person")), ",").alias("shown"))
    return x.groupBy("topic").agg(F.countDistinct("person").alias("n")).join(shown, "topic").select("topic", "shown", F.greatest(c("n") - 5, F.lit(0)).alias("cut"))


@query("so08_path_cap", f"WITH {GRAPH}, x AS (SELECT s.id AS a, p.id AS b, q.id AS c FROM n s JOIN e e1 ON e1.source = s.id AND e1.verb = 'features' JOIN n p ON p.id = e1.target JOIN e e2 ON e2.source = p.id AND e2.verb = 'speaks_on' JOIN n q ON q.id = e2.target WHERE s.type = 'Session') SELECT a, b, c, (SELECT count(*) FROM x) > 300 AS capped FROM x ORDER BY a, b, c LIMIT 300")
def path_cap(s, d):
    """The first 300 paths, and whether there are more."""
    n = nodes(s, d).select("id", "type")
    one = edges(s, d).where("verb = 'features'").select(c("source").alias("a"), c("target").alias("b")).join(n.where("type = 'Session'").select(c("id").alias("a")), "a", "left_semi").join(n.select(c("id").alias("b")), "b", "left_semi")
    two = edges(s, d).where("verb = 'speaks_on'").select(c("source").alias("b"), c("target").alias("c")).join(n.select(c("id").alias("c")), "c", "left_semi")
    first = one.join(two, "b").select("a", "b", "c").orderBy("a", "b", "c").limit(301)
    return first.orderBy("a", "b", "c").limit(300).crossJoin(first.agg((F.count("*") > 300).alias("capped")))


@query("so09_scored_search", "WITH q(w) AS (VALUES ('data'), ('open'), ('energy')) SELECT id, sum(CASE WHEN contains(lower(label), w) THEN 3 ELSE 0 END + CASE WHEN contains(id, w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(pt), w) THEN 1 ELSE 0 END)::BIGINT AS score FROM lexicon, q GROUP BY id HAVING score > 0 ORDER BY score DESC, id LIMIT 5")
def scored_search(s, d):
    q = s.createDataFrame([("data",), ("open",), ("energy",)], "w string")
    score = F.when(F.contains(F.lower("label"), c("w")), 3).otherwise(0) + F.when(F.contains("id", "w"), 2).otherwise(0) + F.when(F.contains(F.lower("pt"), c("w")), 1).otherwise(0)
    return t(s, d, "lexicon").crossJoin(F.broadcast(q)).groupBy("id").agg(F.sum(score).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(5)


query("so10_longest_first", "SELECT id, label FROM lexicon ORDER BY length(label) DESC, id LIMIT 10")(lambda s, d: t(s, d, "lexicon").select("id", "label").orderBy(F.desc(F.length("label")), "id").limit(10))

# ---- set operations
query("st01_union", "SELECT person FROM person_topics UNION SELECT person FROM person_tags")(lambda s, d: t(s, d, "person_topics").select("person").union(t(s, d, "person_tags").select("person")).distinct())
query("st03_difference", "SELECT person, 'topics' AS only_in FROM (SELECT person FROM person_topics EXCEPT SELECT person FROM person_tags) UNION ALL SELECT person, 'tags' FROM (SELECT person FROM person_tags EXCEPT SELECT person FROM person_topics)")(
    lambda s, d: (lambda a, b: a.subtract(b).withColumn("only_in", F.lit("topics")).union(b.subtract(a).withColumn("only_in", F.lit("tags"))))(t(s, d, "person_topics").select("person"), t(s, d, "person_tags").select("person"))
)
query("st04_intersection", "SELECT person FROM person_topics INTERSECT SELECT person FROM person_tags")(lambda s, d: t(s, d, "person_topics").select("person").intersect(t(s, d, "person_tags").select("person")))
query("st05_set_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT 'person:' || id FROM people WHERE id IS NOT NULL EXCEPT SELECT id FROM nodes WHERE type = 'Person') UNION ALL (SELECT id FROM nodes WHERE type = 'Person' EXCEPT SELECT 'person:' || id FROM people WHERE id IS NOT NULL))")(
    lambda s, d: (lambda a, b: a.subtract(b).union(b.subtract(a)).agg((F.count("*") == 0).alias("equal")))(t(s, d, "people").where("id IS NOT NULL").select(F.concat(F.lit("person:"), "id").alias("id")), t(s, d, "nodes").where("type = 'Person'").select("id"))
)
query("st06_distinct", "SELECT DISTINCT type, tag FROM person_tags")(lambda s, d: t(s, d, "person_tags").select("type", "tag").distinct())
query("st07_ordered_distinct", "SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, 'https?://[a-z0-9.-]+')).list_sort(), ' ') AS hosts FROM documents WHERE text IS NOT NULL")(lambda s, d: t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("https?://[a-z0-9.-]+"), F.lit(0)))), " ").alias("hosts")))
query("st08_union_sources", "SELECT id AS entry, label FROM lexicon UNION SELECT entry, label FROM role_list")(lambda s, d: t(s, d, "lexicon").select(c("id").alias("entry"), "label").union(t(s, d, "role_list").select("entry", "label")).distinct())
