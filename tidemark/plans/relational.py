"""The worked SQL queries and the three connection formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.common import EVENT, GRAPH, N, V, edges, nodes
from tidemark.plans.registry import query
from tidemark.session import as_table
from tidemark.tables import table

#: The class of founders as the register of nodes writes it, kinds of common ground, and services that help.
FOUNDERS = "Founding or operating"
GROUND_KINDS = ["Setor", "Tecnologia", "Ideia"]
SERVICE = "Servico"
HELPING = ["incubation", "mentoring", "due-diligence"]
#: So many organisations with the longest lists give the bound of conn_talk; things of more than BLOCK organisations are cut into blocks.
SEEDS = 200
BLOCK = 4000


@query("sql_speakers_by_class", f"WITH {N} SELECT role_class, count(*) AS speakers FROM n WHERE type = 'Person' GROUP BY role_class")
def speakers_by_class(spark, d):
    return nodes(spark, d).where("type = 'Person'").groupBy("role_class").agg(F.count("*").alias("speakers")).orderBy(F.desc("speakers"), "role_class")


@query("sql_orgs_with_several", f"WITH {GRAPH} SELECT o.label AS organisation, count(*) AS speakers FROM e JOIN n p ON p.id = e.source JOIN n o ON o.id = e.target WHERE e.verb = 'listed_under' GROUP BY o.label HAVING count(*) > 1")
def orgs_with_several(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where("verb = 'listed_under'").join(n.select(F.col("id").alias("source")), "source", "left_semi")
    named = e.join(n.select(F.col("id").alias("target"), F.col("label").alias("organisation")), "target")
    return named.groupBy("organisation").agg(F.count("*").alias("speakers")).where("speakers > 1").orderBy(F.desc("speakers"), "organisation")


@query("sql_programme", f"WITH {GRAPH} SELECT n.day, n.time, n.label AS session, n.kind, (SELECT min(s.label) FROM e JOIN n s ON s.id = e.target WHERE e.source = n.id AND e.verb = 'on_stage') AS stage FROM n WHERE n.type = 'Session'")
def programme(spark, d):
    n = nodes(spark, d)
    stage = edges(spark, d).where("verb = 'on_stage'").join(n.select(F.col("id").alias("target"), F.col("label").alias("s")), "target").groupBy(F.col("source").alias("id")).agg(F.min("s").alias("stage"))
    return n.where("type = 'Session'").join(stage, "id", "left").select("day", "time", F.col("label").alias("session"), "kind", "stage").orderBy("day", "time")


@query("sql_arrivals", f"WITH {GRAPH} SELECT p.label AS person, s.label AS snapshot, e.verb FROM e JOIN n p ON p.id = e.source JOIN n s ON s.id = e.target WHERE e.verb IN ('absent_from', 'present_in')")
def arrivals(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where(F.col("verb").isin("absent_from", "present_in"))
    p, s = n.select(F.col("id").alias("source"), F.col("label").alias("person")), n.select(F.col("id").alias("target"), F.col("label").alias("snapshot"))
    return e.join(p, "source").join(s, "target").select("person", "snapshot", "verb").orderBy("person", "snapshot")


@query("sql_no_longer_listed", f"WITH {N} SELECT label AS person, no_longer_listed, source FROM n WHERE type = 'Person' AND no_longer_listed = 1")
def no_longer_listed(spark, d):
    return nodes(spark, d).where("type = 'Person' AND no_longer_listed = 1").select(F.col("label").alias("person"), "no_longer_listed", "source")


@query("sql_verbs", f"WITH {V} SELECT verb, inverse, pt_verb, pt_inverse FROM v")
def verbs(spark, d):
    return G.verbs(spark).select("verb", "inverse", "pt_verb", "pt_inverse").orderBy("verb")


@query("sql_coverage", "SELECT DISTINCT publisher, state, retrieved, substr(sha256, 1, 12) AS sha256_prefix, bytes FROM sources WHERE page LIKE 'press/%'")
def coverage(spark, d):
    s = table(spark, d, "sources").where(F.col("page").startswith("press/"))
    return s.select("publisher", "state", "retrieved", F.substring("sha256", 1, 12).alias("sha256_prefix"), "bytes").distinct().orderBy(F.asc_nulls_last("retrieved"), "publisher")


@query("sql_story_sources", f"WITH {GRAPH} SELECT st.label AS story, src.label AS source FROM e JOIN n st ON st.id = e.source JOIN n src ON src.id = e.target WHERE e.verb = 'attested_by'")
def story_sources(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where("verb = 'attested_by'")
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).join(n.select(F.col("id").alias("a"), F.col("label").alias("story")), "a").join(n.select(F.col("id").alias("b"), F.col("label").alias("source")), "b").select("story", "source").orderBy("story", "source")


@query(
    "sql_path",
    f"""WITH {GRAPH} SELECT s.label AS session, 'part of' AS v1, ev.label AS event, 'features' AS v2, p.label AS person
FROM n s JOIN e e1 ON e1.source = s.id AND e1.verb = 'part_of' JOIN n ev ON ev.id = e1.target JOIN e e2 ON e2.source = s.id AND e2.verb = 'features' JOIN n p ON p.id = e2.target
WHERE s.type = 'Session' ORDER BY s.day NULLS FIRST, s.time NULLS FIRST, s.label NULLS FIRST, ev.label, p.label NULLS FIRST LIMIT 6""",
)
def path(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    hop = lambda verb, name: e.where(F.col("verb") == verb).select(F.col("source").alias("id"), F.col("target").alias("t")).join(n.select(F.col("id").alias("t"), F.col("label").alias(name)), "t").drop("t")
    rows = n.where("type = 'Session'").select("id", "day", "time", F.col("label").alias("session")).join(hop("part_of", "event"), "id").join(hop("features", "person"), "id")
    return rows.orderBy("day", "time", "session", "event", "person").limit(6).select("session", F.lit("part of").alias("v1"), "event", F.lit("features").alias("v2"), "person")


@query("sql_degree", f"WITH {GRAPH} SELECT n.label, n.type, count(*) AS degree FROM n JOIN e ON e.source = n.id OR e.target = n.id GROUP BY n.id, n.label, n.type ORDER BY degree DESC, n.label, n.id LIMIT 10")
def top_degree(spark, d):
    return G.degree(edges(spark, d)).join(nodes(spark, d), "id").orderBy(F.desc("degree"), "label", "id").limit(10).select("label", "type", "degree")


@query(
    "sql_two_hops",
    f"""WITH RECURSIVE {GRAPH}, w AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e),
hop AS (SELECT '{EVENT}' AS id, 0 AS depth UNION SELECT w.b, hop.depth + 1 FROM hop JOIN w ON w.a = hop.id WHERE hop.depth < 2)
SELECT n.type, count(DISTINCT n.id) AS nodes FROM hop JOIN n ON n.id = hop.id GROUP BY n.type""",
)
def two_hops(spark, d):
    reached = G.within_hops(edges(spark, d), spark.createDataFrame([(EVENT,)], "id string"), 2)
    return reached.join(nodes(spark, d), "id").groupBy("type").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"))


@query("sql_json_arrays", "SELECT DISTINCT o.name AS organisation, x.person FROM orgs o, LATERAL (SELECT unnest(from_json(o.people, '[\"VARCHAR\"]')) AS person) x")
def json_arrays(spark, d):
    return table(spark, d, "orgs").select(F.col("name").alias("organisation"), F.explode(F.from_json("people", "array<string>")).alias("person")).distinct().orderBy("organisation", "person")


@query("sql_topics", "SELECT topic, count(*) AS speakers FROM person_topics GROUP BY topic")
def topics(spark, d):
    return table(spark, d, "person_topics").groupBy("topic").agg(F.count("*").alias("speakers")).orderBy(F.desc("speakers"), "topic")


@query("sql_tags_evidence", "SELECT t.type, l.label AS tag, t.matched, count(*) AS people FROM person_tags t JOIN lexicon l ON l.id = t.tag GROUP BY ALL ORDER BY people DESC, t.type, tag, t.matched NULLS FIRST LIMIT 40")
def tags_evidence(spark, d):
    lex = table(spark, d, "lexicon").select(F.col("id").alias("tag"), "label")
    t = table(spark, d, "person_tags").join(lex, "tag")
    return t.groupBy("type", F.col("label").alias("tag"), "matched").agg(F.count("*").alias("people")).orderBy(F.desc("people"), "type", "tag", "matched").limit(40)


@query("sql_register_sizes", "SELECT snapshot, count(*) AS pages, sum(bytes)::BIGINT AS bytes FROM sources GROUP BY snapshot")
def register_sizes(spark, d):
    return table(spark, d, "sources").groupBy("snapshot").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes")).orderBy("snapshot")


def person_orgs(spark, d):
    """(person, org), distinct, without placeholder organisations and null ones (as NOT IN drops them)."""
    no = table(spark, d, "orgs").where("placeholder = 1 AND name IS NOT NULL").select(F.col("name").alias("org")).distinct()
    p = table(spark, d, "people").where("id IS NOT NULL AND org IS NOT NULL").select(F.col("id").alias("person"), "org").distinct()
    return p.join(no, "org", "left_anti")


def ground(spark, d):
    """(org, kind, what), distinct: what the persons of an organisation stand on."""
    po = person_orgs(spark, d)
    tags = table(spark, d, "person_tags").where(F.col("type").isin(*GROUND_KINDS)).select("person", F.col("type").alias("kind"), F.col("tag").alias("what"))
    tops = table(spark, d, "person_topics").select("person", F.lit("Topic").alias("kind"), F.col("topic").alias("what"))
    return po.join(tags.unionByName(tops), "person").select("org", "kind", "what").distinct()


def offers(spark, d):
    t = table(spark, d, "person_tags").where(F.col("type") == SERVICE).select("person", F.col("tag").alias("service"))
    return person_orgs(spark, d).join(t, "person").select("org", "service").distinct()


def founder_led(spark, d):
    no = table(spark, d, "orgs").where("placeholder = 1 AND name IS NOT NULL").select(F.col("name").alias("org")).distinct()
    f = nodes(spark, d).where((F.col("type") == "Person") & (F.col("role_class") == FOUNDERS) & F.col("org").isNotNull()).select("org").distinct()
    return f.join(no, "org", "left_anti")


CTES = f"""{N},
no AS (SELECT name FROM orgs WHERE placeholder = 1 AND name IS NOT NULL),
po AS (SELECT DISTINCT id AS person, org FROM people WHERE id IS NOT NULL AND org NOT IN (SELECT name FROM no)),
ground AS (SELECT DISTINCT org, type AS kind, tag AS what FROM po JOIN person_tags USING (person) WHERE type IN ('Setor', 'Tecnologia', 'Ideia')
           UNION SELECT DISTINCT org, 'Topic', topic FROM po JOIN person_topics USING (person)),
offers AS (SELECT DISTINCT org, tag AS service FROM po JOIN person_tags USING (person) WHERE type = '{SERVICE}'),
founder_led AS (SELECT DISTINCT org FROM n WHERE type = 'Person' AND role_class = '{FOUNDERS}' AND org IS NOT NULL AND org NOT IN (SELECT name FROM no))"""

query("cte_ground", f"WITH {CTES} SELECT * FROM ground")(ground)
query("cte_offers", f"WITH {CTES} SELECT * FROM offers")(offers)
query("cte_founder_led", f"WITH {CTES} SELECT * FROM founder_led")(founder_led)

TALK = f"""WITH {CTES} SELECT a.org AS org_a, b.org AS org_b, count(*) AS shared, string_agg(a.kind || ':' || a.what, ' · ' ORDER BY a.kind || ':' || a.what) AS on_what
FROM ground a JOIN ground b ON a.kind = b.kind AND a.what = b.what AND a.org < b.org GROUP BY a.org, b.org HAVING count(*) >= 3 ORDER BY shared DESC, org_a, org_b LIMIT 40"""


def _listed(c: str):
    return F.array_join(F.sort_array(F.collect_list(c)), " · ")


def numbered(df, name: str, ident: str):
    """(name, ident) of the distinct values; written once, so that the numbers stay the same whenever they are read."""
    return as_table(df.select(name).distinct().withColumn(ident, F.monotonically_increasing_id()), "numbers")


def best(counts, most: int):
    """The rows of (.., shared) that can be among the first `most`, ties included."""
    least = counts.orderBy(F.desc("shared")).limit(most).agg(F.min("shared")).first()[0]
    return counts.where(F.col("shared") >= (least or 0))


def last_of(pairs, most: int) -> int:
    """The least `shared` of the best `most` pairs; 3, as the report asks for, if there are fewer."""
    least, n = pairs.where("shared >= 3").orderBy(F.desc("shared")).limit(most).agg(F.min("shared"), F.count("*")).first()
    return least if n == most else 3


def talk_bound(g, sizes, most: int) -> int:
    """A number the best `most` pairs reach at least: that of the last of `most` pairs among SEEDS organisations with long lists."""
    some = g.join(sizes.orderBy(F.desc("n"), "org").limit(SEEDS).select("org"), "org", "left_semi")
    met = some.alias("a").join(some.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.org") < F.col("b.org")))
    return last_of(met.groupBy("a.org", "b.org").agg(F.count("*").alias("shared")), most)


def closer_bound(lists, most: int) -> int:
    """The same over all lists (org, ws), as the longest may share little: each meets those of about its length, SEEDS at a time."""
    near = as_table(lists.orderBy(F.desc(F.size("ws")), "org").withColumn("near", F.floor(F.monotonically_increasing_id() / SEEDS)), "talk-near")
    met = near.alias("a").join(near.alias("b"), (F.col("a.near") == F.col("b.near")) & (F.col("a.org") < F.col("b.org")))
    return last_of(met.select(F.size(F.array_intersect("a.ws", "b.ws")).alias("shared")), most)


def talk_pairs(lists, least: int):
    """(org_a, org_b, ws) of all pairs with at least `least` things in common, of lists (org, ws) sorted alike.

    The first thing two such lists share has least - 1 behind it in both, so
    organisations need to meet only on the things in front of their last
    least - 1, and a pair is taken at the first thing it shares. No pair is
    shuffled. Things with more than BLOCK organisations meet in pairs of blocks.
    """
    front = lists.select("org", "ws", F.explode(F.slice("ws", F.lit(1), F.size("ws") - F.lit(least - 1))).alias("w"))
    parts = front.groupBy("w").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    rows = front.join(parts, "w").withColumn("b", F.pmod(F.xxhash64("org"), F.col("k")).cast("int"))
    left = rows.select("w", F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), F.col("k") - 1)).alias("y"), F.col("org").alias("p"), F.col("ws").alias("ps"))
    right = rows.select("w", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), F.col("org").alias("q"), F.col("ws").alias("qs"))
    met = left.join(right, ["w", "x", "y"]).where("x < y OR p < q").select("w", "p", "q", F.array_intersect("ps", "qs").alias("ws"))
    return met.where((F.size("ws") >= least) & (F.get("ws", F.lit(0)) == F.col("w"))).select(F.least("p", "q").alias("org_a"), F.greatest("p", "q").alias("org_b"), "ws")


def conn_talk(spark, d):
    """Pairs among the longest lists bound the report from below, and pairs of lists of about equal length if that leaves many; only organisations whose lists reach that bound meet at all."""
    g = as_table(ground(spark, d).where("what IS NOT NULL").select("org", F.concat("kind", F.lit(":"), "what").alias("t")), "ground")
    sizes = g.groupBy("org").agg(F.count("*").alias("n"))
    least = talk_bound(g, sizes, 40)
    rows = as_table(g.join(sizes.where(F.col("n") >= least).select("org"), "org", "left_semi"), "talk-rows")
    what = as_table(rows.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").orderBy("n", "t").select("t", F.monotonically_increasing_id().alias("w")), "numbers")  # rare things first
    lists = as_table(rows.join(what, "t").groupBy("org").agg(F.sort_array(F.collect_list("w")).alias("ws")).where(F.size("ws") >= least), "talk-lists")
    if lists.count() > 10 * SEEDS:
        least = max(least, closer_bound(lists, 40))
        lists = lists.where(F.size("ws") >= least)
    top = talk_pairs(lists, least).withColumn("shared", F.size("ws").cast("long")).orderBy(F.desc("shared"), "org_a", "org_b").limit(40)
    both = top.select("org_a", "org_b", "shared", F.explode("ws").alias("w")).join(what, "w")
    return both.groupBy("org_a", "org_b", "shared").agg(_listed("t").alias("on_what")).orderBy(F.desc("shared"), "org_a", "org_b")


query("conn_talk", TALK)(conn_talk)
query("sql_orgs_should_talk", TALK)(conn_talk)


@query(
    "conn_buy",
    f"""WITH {CTES}, s AS (SELECT DISTINCT service FROM offers),
lacking AS (SELECT s.service, f.org FROM s, founder_led f WHERE NOT EXISTS (SELECT 1 FROM offers x WHERE x.service = s.service AND x.org = f.org))
SELECT s.service, (SELECT string_agg(org, ' · ' ORDER BY org) FROM offers x WHERE x.service = s.service) AS providers,
(SELECT count(*) FROM lacking l WHERE l.service = s.service) AS founder_led_without_it,
(SELECT string_agg(org, ' · ' ORDER BY org) FROM (SELECT org FROM lacking l WHERE l.service = s.service ORDER BY org LIMIT 12)) AS for_example FROM s WHERE s.service IS NOT NULL""",
)
def conn_buy(spark, d):
    """The doubly correlated NOT IN as services x founders (the lexicon's services are few) and an anti-join."""
    o = offers(spark, d).where("service IS NOT NULL")
    by = o.groupBy("service").agg(_listed("org").alias("providers"))
    f = founder_led(spark, d)
    lacking = f.crossJoin(o.select("service").distinct()).join(o, ["org", "service"], "left_anti")
    from pyspark.sql import Window

    first = lacking.withColumn("k", F.row_number().over(Window.partitionBy("service").orderBy("org"))).where("k <= 12").groupBy("service").agg(_listed("org").alias("for_example"))
    n = lacking.groupBy("service").agg(F.count("*").alias("founder_led_without_it"))
    return by.join(n, "service", "left").join(first, "service", "left").select("service", "providers", F.coalesce("founder_led_without_it", F.lit(0)).alias("founder_led_without_it"), "for_example")


@query(
    "conn_help",
    f"""WITH {CTES} SELECT o.org AS provider, o.service AS offer, f.org AS founder_led, count(*) AS shared, string_agg(g2.kind || ':' || g2.what, ' · ' ORDER BY g2.kind || ':' || g2.what) AS on_what
FROM offers o JOIN founder_led f ON f.org <> o.org JOIN ground g1 ON g1.org = o.org JOIN ground g2 ON g2.org = f.org AND g2.kind = g1.kind AND g2.what = g1.what
WHERE o.service IN ('incubation', 'mentoring', 'due-diligence') GROUP BY ALL HAVING count(*) >= 2 ORDER BY shared DESC, provider, offer, founder_led LIMIT 40""",
)
def conn_help(spark, d):
    """Shared ground is counted once per pair of organisations on numbers, then each offer of the provider gets it."""
    g = as_table(ground(spark, d).where("what IS NOT NULL").select("org", F.concat("kind", F.lit(":"), "what").alias("t")), "ground")
    org, what = numbered(g, "org", "o"), numbered(g, "t", "w")
    rows = as_table(g.join(org, "org").join(what, "t").select("o", "w"), "ground")
    give = offers(spark, d).where(F.col("service").isin(*HELPING)).join(org, "org").select("o", F.col("org").alias("provider"), F.col("service").alias("offer"))
    take = founder_led(spark, d).join(org, "org").select("o", F.col("org").alias("founder_led"))
    have, need = rows.join(give.select("o").distinct(), "o", "left_semi"), rows.join(take.select("o"), "o", "left_semi")
    pairs = have.alias("a").join(need.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.o") != F.col("b.o")))
    counts = as_table(pairs.groupBy(F.col("a.o").alias("x"), F.col("b.o").alias("y")).agg(F.count("*").alias("shared")).where("shared >= 2"), "help")
    named = best(counts, 40).join(give.withColumnRenamed("o", "x"), "x").join(take.withColumnRenamed("o", "y"), "y")
    top = named.orderBy(F.desc("shared"), "provider", "offer", "founder_led").limit(40)
    both = top.join(rows.select(F.col("o").alias("x"), "w"), "x").join(rows.select(F.col("o").alias("y"), "w"), ["y", "w"]).join(what, "w")
    return both.groupBy("provider", "offer", "founder_led", "shared").agg(_listed("t").alias("on_what")).orderBy(F.desc("shared"), "provider", "offer", "founder_led")
