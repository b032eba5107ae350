"""Snapshots, excerpts, grounding, activity, threads and translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import snapshots as S
from tidemark.operators.captures import captures, latest_rows
from tidemark.operators.phrases import mentions
from tidemark.operators.skew import salted_join
from tidemark.plans.common import GRAPH, N, edges, nodes
from tidemark.plans.evolution import WINNERS
from tidemark.plans.registry import query
from tidemark.session import as_table
from tidemark.tables import table as t

c = F.col




PAIRS = f"""WITH {WINNERS}, pairs AS (SELECT a.id, a.k + 1 AS k, b.id IS NULL AS gone, a.name AS n0, b.name AS n1, a.role AS r0, b.role AS r1, a.org AS o0, b.org AS o1 FROM win a LEFT JOIN win b ON b.id = a.id AND b.k = a.k + 1 WHERE a.k < (SELECT max(k) FROM cap)),
ch AS (SELECT k, id, 'name' AS field, n0 AS was, n1 AS now FROM pairs WHERE NOT gone AND n0 IS DISTINCT FROM n1 UNION ALL SELECT k, id, 'role', r0, r1 FROM pairs WHERE NOT gone AND r0 IS DISTINCT FROM r1 UNION ALL SELECT k, id, 'org', o0, o1 FROM pairs WHERE NOT gone AND o0 IS DISTINCT FROM o1)"""


@query("ev01_snapshot_diff", f"{PAIRS}, kinds AS (SELECT k, field AS change FROM ch UNION ALL SELECT k, 'removed' FROM pairs WHERE gone UNION ALL SELECT b.k, 'added' FROM win b LEFT JOIN win a ON a.id = b.id AND a.k = b.k - 1 WHERE b.k > 0 AND a.id IS NULL) SELECT cap.snapshot AS to_snapshot, change, count(*) AS n FROM kinds JOIN cap USING (k) GROUP BY ALL")
def all_changes(s, d):
    """Counts of every kind of change per capture: 'added', 'removed', or the field that changed."""
    diff, known = S.changes(t(s, d, "people"))
    return diff.groupBy("ordinal", "change").agg(F.count("*").alias("n")).select(known.name_at(c("ordinal")).alias("to_snapshot"), "change", "n")


@query("ev01_changed_values", f"{PAIRS} SELECT cap.snapshot AS to_snapshot, ch.id AS person, field, was, now FROM ch JOIN cap USING (k)")
def changed_values(s, d):
    values = ["name", "role", "org"]
    people = t(s, d, "people")
    known = captures(people)
    x = S.changed_values(latest_rows(people, known, "id", values), known, values)
    return x.select(known.name_at(c("ordinal")).alias("to_snapshot"), c("key").alias("person"), "field", "was", "now")


query("ev02_declared_count", "SELECT o.id, coalesce(json_array_length(o.people), 0)::BIGINT AS declared, (SELECT count(DISTINCT p.id) FROM people p WHERE p.org = o.name) AS counted FROM (SELECT DISTINCT id, name, people FROM orgs) o")(
    lambda s, d: t(s, d, "orgs").select("id", "name", "people").distinct().join(t(s, d, "people").groupBy(c("org").alias("name")).agg(F.countDistinct("id").alias("k")), "name", "left").select("id", F.coalesce(F.json_array_length("people"), F.lit(0)).cast("bigint").alias("declared"), F.coalesce("k", F.lit(0)).alias("counted"))
)
query("ev03_readable", "SELECT DISTINCT id, length(frozen) > 1200 AS readable FROM sources WHERE frozen IS NOT NULL")(lambda s, d: t(s, d, "sources").where("frozen IS NOT NULL").select("id", (F.length("frozen") > 1200).alias("readable")).distinct())
VERDICT = "CASE WHEN state = 'excluded' THEN 'blocked' WHEN frozen IS NULL OR frozen = '' THEN 'unreadable' WHEN length(frozen) <= 400 THEN 'rendered by script' ELSE 'ok' END"
query("ev04_verdict", f"SELECT DISTINCT id, {VERDICT} AS verdict FROM sources")(lambda s, d: t(s, d, "sources").select("id", F.expr(VERDICT).alias("verdict")).distinct())


@query("ev05_claims", "WITH s AS (SELECT DISTINCT id, state, frozen, list_filter(string_split(frozen, chr(10)), lambda x: length(trim(x)) >= 60) AS ls FROM sources WHERE id IS NOT NULL), x AS (SELECT id, unnest(['whole', 'pieces', 'invented']) AS claim, state = 'excluded' OR frozen IS NULL OR length(frozen) <= 400 AS shut FROM s WHERE frozen IS NULL OR state = 'excluded' OR length(frozen) <= 400 OR len(ls) >= 3) SELECT DISTINCT id, claim, CASE WHEN shut THEN 'fonte_inacessivel' WHEN claim = 'invented' THEN 'nao_encontrada' ELSE 'confirmada' END AS verdict, CASE WHEN NOT shut THEN CASE claim WHEN 'whole' THEN 'exacta' WHEN 'pieces' THEN 'fragmentada' END END AS kind FROM x")
def claims(s, d):
    """Three claims about every page, verified by locating their excerpts in it.

    A line of the page as it stands, two lines with what is between them left
    out, and a line with words in it that the page doesn't have.
    """
    lines = F.filter(F.split("frozen", "\n", -1), lambda x: F.length(F.trim(x)) >= 60)
    shut = F.coalesce(c("state") == "excluded", F.lit(False)) | c("frozen").isNull() | (F.length("frozen") <= 400)
    x = t(s, d, "sources").where("id IS NOT NULL").select("id", "frozen", lines.alias("ls"), shut.alias("shut")).distinct().where("shut OR size(ls) >= 3")
    at = lambda i: F.get("ls", F.lit(i))
    claim = lambda name, text: F.struct(F.lit(name).alias("claim"), text.alias("excerpt"))
    made = F.array(claim("whole", at(0)), claim("pieces", F.concat(at(0), F.lit(" "), at(2))), claim("invented", F.concat(at(0), F.lit(" zzz never told zzz "), at(2))))
    x = x.select("id", "frozen", "shut", F.inline(made)).withColumn("r", X.located(X.level(c("excerpt")), X.level(c("frozen"))))
    verdict = F.when(c("shut"), "fonte_inacessivel").when(c("r.kind").isNotNull(), "confirmada").otherwise("nao_encontrada")
    return x.select("id", "claim", verdict.alias("verdict"), F.when(~c("shut"), c("r.kind")).alias("kind")).distinct()


DECIDED = "CASE WHEN d.tag IS NOT NULL THEN 'decidido:' || d.tag WHEN t.tag IS NOT NULL AND l.id IS NOT NULL THEN 'aceite' WHEN t.tag IS NOT NULL THEN 'rejeitado' WHEN t.matched IS NULL THEN 'vazio' ELSE 'por_decidir' END"


@query("ev06_overlay", f"WITH d AS (SELECT matched, min(tag) AS tag FROM person_tags WHERE tag IS NOT NULL AND matched IS NOT NULL GROUP BY matched HAVING count(DISTINCT tag) = 1) SELECT t.person, t.matched, {DECIDED} AS state FROM person_tags t LEFT JOIN lexicon l ON l.id = t.tag LEFT JOIN d ON d.matched = t.matched AND t.tag IS NULL")
def overlay(s, d):
    """The state of each matched word: tags somebody gave are accepted if declared; open words take the one decision made elsewhere on the same word."""
    x = t(s, d, "person_tags")
    decided = x.where("tag IS NOT NULL AND matched IS NOT NULL").groupBy("matched").agg(F.min("tag").alias("dtag"), F.countDistinct("tag").alias("k")).where("k = 1").select("matched", "dtag")
    x = salted_join(x.select("person", "matched", "tag"), decided, ["matched"]).join(t(s, d, "lexicon").select(c("id").alias("tag"), F.lit(True).alias("known")), "tag", "left")
    state = F.when(c("tag").isNull() & c("dtag").isNotNull(), F.concat(F.lit("decidido:"), "dtag")).when(c("tag").isNotNull() & c("known"), "aceite").when(c("tag").isNotNull(), "rejeitado").when(c("matched").isNull(), "vazio").otherwise("por_decidir")
    return x.select("person", "matched", state.alias("state"))


@query("ev07_grounding", f"WITH {N}, s AS (SELECT id, max(frozen) AS f FROM sources GROUP BY id) SELECT n.id, CASE WHEN contains(s.f, n.label) THEN 'bytes' WHEN s.id IS NOT NULL THEN 'registo' ELSE 'none' END AS ground, length(label) >= 6 AND type IN ('Person', 'Organisation') AND s.id IS NOT NULL AS linkable FROM n LEFT JOIN s ON s.id = n.source")
def grounding(s, d):
    """An entity stands on the bytes of its source if its label is in them, else on the register if the source is."""
    src = t(s, d, "sources").groupBy(c("id").alias("source")).agg(F.max("frozen").alias("f"), F.lit(True).alias("b"))
    g = salted_join(nodes(s, d).select("id", "label", "type", "source"), src, ["source"])
    ground = F.when(F.contains("f", "label"), "bytes").when(c("b"), "registo").otherwise("none")
    return g.select("id", ground.alias("ground"), ((F.length("label") >= 6) & c("type").isin("Person", "Organisation") & c("b").isNotNull()).alias("linkable"))


@query("ev08_stage_names", f"WITH {N} SELECT DISTINCT s.id, st.label AS stage FROM (SELECT DISTINCT id, frozen FROM sources WHERE frozen IS NOT NULL) s JOIN (SELECT DISTINCT label FROM n WHERE type = 'Stage') st ON contains(s.frozen, st.label)")
def stage_names(s, d):
    pages_ = t(s, d, "sources").where("frozen IS NOT NULL").select(c("id").alias("key"), c("frozen").alias("text"))
    return mentions(pages_, nodes(s, d).where("type = 'Stage'").select(c("label").alias("name"), c("label").alias("phrase"))).select(c("key").alias("id"), c("name").alias("stage")).distinct()


ACTIVITY = """SELECT 'topic' AS kind, person AS agent, topic AS about, source AS pointer FROM person_topics UNION ALL SELECT 'tag', person, coalesce(tag, matched), source FROM person_tags
UNION ALL SELECT 'capture', publisher, id, url FROM sources UNION ALL SELECT 'document', source, CAST(doc_id AS VARCHAR), kind FROM documents UNION ALL SELECT 'event', CAST(user_id AS VARCHAR), event_type, CAST(event_id AS VARCHAR) FROM events"""


def _activity(s, d) -> DataFrame:
    row = lambda df, kind, a, b, p: df.select(F.lit(kind).alias("kind"), a.cast("string").alias("agent"), b.cast("string").alias("about"), p.cast("string").alias("pointer"))
    parts = [
        row(t(s, d, "person_topics"), "topic", c("person"), c("topic"), c("source")),
        row(t(s, d, "person_tags"), "tag", c("person"), F.coalesce("tag", "matched"), c("source")),
        row(t(s, d, "sources"), "capture", c("publisher"), c("id"), c("url")),
        row(t(s, d, "documents"), "document", c("source"), c("doc_id"), c("kind")),
        row(t(s, d, "events"), "event", c("user_id"), c("event_type"), c("event_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("ev09_activity", ACTIVITY)(_activity)
query("ev10_open_work", "SELECT person, count(*) FILTER (tag IS NULL) AS open FROM person_tags GROUP BY person")(lambda s, d: t(s, d, "person_tags").groupBy("person").agg(F.count_if(c("tag").isNull()).alias("open")))


@query("ev13_queue", f"WITH {N} SELECT 'tag' AS what, person AS id FROM person_tags WHERE tag IS NULL UNION ALL SELECT 'page', id FROM sources WHERE state = 'excluded' UNION ALL SELECT 'node', id FROM n WHERE type = 'Person' AND org IS NULL UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR) FROM documents WHERE text IS NULL")
def queue(s, d):
    one = lambda df, what, key: df.select(F.lit(what).alias("what"), c(key).cast("string").alias("id"))
    return one(t(s, d, "person_tags").where("tag IS NULL"), "tag", "person").unionByName(one(t(s, d, "sources").where("state = 'excluded'"), "page", "id")).unionByName(one(nodes(s, d).where("type = 'Person' AND org IS NULL"), "node", "id")).unionByName(one(t(s, d, "documents").where("text IS NULL"), "doc", "doc_id"))


@query("ev14_pending", f"WITH {N} SELECT DISTINCT 'word' AS what, u.matched AS id FROM person_tags u WHERE u.tag IS NULL AND u.matched IS NOT NULL AND NOT EXISTS (SELECT 1 FROM person_tags k WHERE k.tag IS NOT NULL AND k.matched = u.matched) UNION ALL SELECT 'page', id FROM (SELECT id FROM sources WHERE id IS NOT NULL GROUP BY id HAVING count(*) FILTER (state = 'primary') = 0) UNION ALL SELECT 'class', id FROM n WHERE type = 'Person' AND role_class IS NULL")
def pending(s, d):
    """What waits for a decision: words nobody has mapped, pages without a primary copy, persons without a class."""
    x = t(s, d, "person_tags").where("matched IS NOT NULL")
    words = x.where("tag IS NULL").select("matched").distinct().join(x.where("tag IS NOT NULL").select("matched").distinct(), "matched", "left_anti").select(F.lit("word").alias("what"), c("matched").alias("id"))
    pages_ = t(s, d, "sources").where("id IS NOT NULL").groupBy("id").agg(F.count_if(c("state") == "primary").alias("n")).where("n = 0").select(F.lit("page").alias("what"), "id")
    return words.unionByName(pages_).unionByName(nodes(s, d).where("type = 'Person' AND role_class IS NULL").select(F.lit("class").alias("what"), "id"))
query("ev15_feed", f"WITH {N} SELECT * FROM (SELECT 'node' AS what, id, recorded AS at FROM n ORDER BY recorded DESC, id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'doc', CAST(doc_id AS VARCHAR), loaded FROM documents WHERE loaded IS NOT NULL ORDER BY loaded DESC, doc_id LIMIT 8)")(
    lambda s, d: nodes(s, d).select(F.lit("node").alias("what"), "id", c("recorded").alias("at")).orderBy(F.desc("at"), "id").limit(8).unionByName(t(s, d, "documents").where("loaded IS NOT NULL").select(F.lit("doc").alias("what"), c("doc_id").cast("string").alias("id"), c("loaded").alias("at"), "doc_id").orderBy(F.desc("at"), "doc_id").limit(8).drop("doc_id"))
)
query("ev16_alias", "WITH a AS (SELECT name, min(id) AS id FROM orgs GROUP BY name) SELECT DISTINCT p.org, coalesce(a.id, p.org) AS resolved FROM people p LEFT JOIN a ON a.name = p.org WHERE p.org IS NOT NULL")(lambda s, d: t(s, d, "people").where("org IS NOT NULL").select("org").distinct().join(t(s, d, "orgs").groupBy(c("name").alias("org")).agg(F.min("id").alias("r")), "org", "left").select("org", F.coalesce("r", "org").alias("resolved")))
query("ev17_unknown", f"WITH {N} SELECT DISTINCT person FROM (SELECT person FROM person_topics UNION ALL SELECT person FROM person_tags) u WHERE person IS NOT NULL AND person NOT IN (SELECT id FROM people WHERE id IS NOT NULL) AND 'person:' || person NOT IN (SELECT id FROM n)")(
    lambda s, d: t(s, d, "person_topics").select("person").unionByName(t(s, d, "person_tags").select("person")).where("person IS NOT NULL").distinct().join(t(s, d, "people").where("id IS NOT NULL").select(c("id").alias("person")).distinct(), "person", "left_anti").join(nodes(s, d).select(F.expr("substring(id, 8)").alias("person"), c("id").alias("nid")).where("nid LIKE 'person:%'").select("person").distinct(), "person", "left_anti")
)


def threads(messages: DataFrame) -> DataFrame:
    """(id, root, depth) of messages (id, parent): roots have no delivered parent; a cycle has no root and gives no row.

    A frontier loop: each round joins only the replies found last, until there
    are none. A message with several parents counts at its least depth below a
    root, so a cycle behind such a one ends, too.
    """
    m = as_table(messages.select("id", "parent").distinct(), "messages")
    found = frontier = as_table(m.join(m.select(c("id").alias("parent")), "parent", "left_anti").select("id", c("id").alias("root"), F.lit(0).alias("depth")).distinct(), "roots")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        replies = frontier.select(c("id").alias("parent"), "root").join(m, "parent").select("id", "root", F.lit(depth).alias("depth")).distinct()
        frontier = as_table(replies.join(found.select("id", "root"), ["id", "root"], "left_anti"), "replies")
        found = found.unionByName(frontier)
        if depth % 16 == 0:  # else the plan grows with the depth
            found = as_table(found, "threads")
    return found


@query("ev18_threads", "WITH RECURSIVE m AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - 1 END AS parent FROM events), th AS (SELECT id, id AS root, 0 AS depth FROM m WHERE parent IS NULL OR parent NOT IN (SELECT id FROM m) UNION ALL SELECT m.id, th.root, th.depth + 1 FROM m JOIN th ON m.parent = th.id) SELECT id, root, depth FROM th")
def mail_threads(s, d):
    """Events in runs of five stand for messages that answer the one before."""
    return threads(t(s, d, "events").select(c("event_id").alias("id"), F.when(c("event_id") % 5 != 0, c("event_id") - 1).alias("parent")))


TM = r"""WITH m AS (SELECT DISTINCT matched FROM person_tags WHERE matched IS NOT NULL), served AS (SELECT DISTINCT matched FROM person_tags WHERE tag IS NOT NULL),
lex AS (SELECT id, label, pt, lower(label) AS l, lower(pt) AS p FROM lexicon), masked AS (SELECT DISTINCT regexp_replace(lower(label), '[^a-z]+', '', 'g') AS k FROM lexicon)
SELECT m.matched, CASE WHEN m.matched IN (SELECT matched FROM served) THEN 'served' WHEN m.matched IN (SELECT label FROM lex) THEN 'exact' WHEN lower(m.matched) IN (SELECT l FROM lex) OR lower(m.matched) IN (SELECT p FROM lex WHERE p IS NOT NULL) THEN 'machine'
WHEN regexp_matches(m.matched, '^[0-9.,:/-]+$') THEN 'verbatim' WHEN regexp_replace(lower(m.matched), '[«»"“”…*;,.]+', '', 'g') IN (SELECT l FROM lex) THEN 'quote mask' WHEN regexp_replace(lower(m.matched), '[^a-z]+', '', 'g') IN (SELECT k FROM masked) THEN 'template' ELSE 'miss' END AS how FROM m"""


@query("ev19_memory_lookup", TM)
def memory_lookup(s, d):
    """Lookups in order of trust, the first that hits wins: already served, exact, machine, verbatim, without quotes, by template, miss.

    Each step is an equi-join on a key of its own; what is served is looked up among the words themselves.
    """
    x, lex = t(s, d, "person_tags").where("matched IS NOT NULL"), t(s, d, "lexicon")
    bare = lambda e: F.regexp_replace(F.lower(e), "[^a-z]+", "")
    m = x.select("matched").distinct().select("matched", F.lower("matched").alias("l"), F.regexp_replace(F.lower("matched"), '[«»"“”…*;,.]+', "").alias("q"), bare("matched").alias("k"))
    hits = [
        ("served", x.where("tag IS NOT NULL").select("matched"), "matched"), ("exact", lex.select(c("label").alias("matched")), "matched"),
        ("machine", lex.select(F.explode(F.array(F.lower("label"), F.lower("pt"))).alias("l")), "l"), ("quote mask", lex.select(F.lower("label").alias("q")), "q"), ("template", lex.select(bare("label").alias("k")), "k"),
    ]
    for name, keys, on in hits:
        m = m.join(keys.distinct().withColumn(name, F.lit(True)), on, "left")
    how = F.when(c("served"), "served").when(c("exact"), "exact").when(c("machine"), "machine").when(c("matched").rlike("^[0-9.,:/-]+$"), "verbatim").when(c("quote mask"), "quote mask").when(c("template"), "template").otherwise("miss")
    return m.select("matched", how.alias("how"))


ORIGINS = "SELECT pt AS text, 'lexicon' AS origin FROM lexicon UNION ALL SELECT pt, 'roles' FROM role_list UNION ALL SELECT label, 'graph' FROM nodes UNION ALL SELECT topic, 'topics' FROM person_topics"


@query("ev20_segments", f"SELECT substr(sha256(text), 1, 16) AS key, text, count(*) AS n, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM ({ORIGINS}) WHERE text IS NOT NULL GROUP BY text")
def segments(s, d):
    """Segments of four origins with where they come from; at most four names per segment are collected."""
    one = lambda tb, col, origin: t(s, d, tb).select(c(col).alias("text"), F.lit(origin).alias("origin"))
    x = one("lexicon", "pt", "lexicon").unionByName(one("role_list", "pt", "roles")).unionByName(one("nodes", "label", "graph")).unionByName(one("person_topics", "topic", "topics")).where("text IS NOT NULL")
    return x.groupBy("text").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("origins")).select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), "text", "n", "origins")
@query("ev21_apply_batch", "WITH b AS (SELECT tag AS id, max(matched) AS pt FROM person_tags WHERE tag IS NOT NULL AND matched IS NOT NULL GROUP BY tag) SELECT l.id, coalesce(b.pt, l.pt) AS pt, b.id IS NOT NULL AS updated FROM lexicon l LEFT JOIN b ON b.id = l.id UNION ALL SELECT b.id, NULL, false FROM b WHERE b.id NOT IN (SELECT id FROM lexicon)")
def apply_batch(s, d):
    """A batch of wordings written over a memory: known keys are updated, others kept, keys the memory doesn't know refused (null)."""
    lex = t(s, d, "lexicon").select("id", c("pt").alias("old"), F.lit(True).alias("known"))
    batch = t(s, d, "person_tags").where("tag IS NOT NULL AND matched IS NOT NULL").groupBy(c("tag").alias("id")).agg(F.max("matched").alias("new"))
    x = lex.join(batch, "id", "full")
    return x.select("id", F.when(c("known"), F.coalesce("new", "old")).alias("pt"), (c("known").isNotNull() & c("new").isNotNull()).alias("updated"))
#: Letters a batch may have.
BUDGET = 2_000


@query("ev22_todo", f"WITH k AS (SELECT lower(label) AS l FROM lexicon UNION SELECT lower(pt) FROM lexicon WHERE pt IS NOT NULL), m AS (SELECT matched, count(*) AS n FROM person_tags WHERE tag IS NULL AND matched <> '' AND lower(matched) NOT IN (SELECT l FROM k) GROUP BY matched) SELECT matched, n FROM (SELECT *, sum(length(matched)) OVER (ORDER BY n DESC, length(matched), matched ROWS UNBOUNDED PRECEDING) AS used FROM m) WHERE used <= {BUDGET}")
def todo(s, d):
    """Words the memory lacks, most frequent and then shortest first, until the budget of letters is used.

    As each has a letter at least, the first BUDGET of them hold the batch, and the running sum is over these only.
    """
    known = t(s, d, "lexicon").select(F.explode(F.array(F.lower("label"), F.lower("pt"))).alias("l")).distinct()
    m = t(s, d, "person_tags").where("tag IS NULL AND matched <> ''").withColumn("l", F.lower("matched")).join(known, "l", "left_anti").groupBy("matched").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.length("matched"), "matched"]
    first = m.orderBy(*order).limit(BUDGET)
    return first.withColumn("used", F.sum(F.length("matched")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(c("used") <= BUDGET).select("matched", "n")
@query("ev23_blockers", "SELECT DISTINCT d.doc_id, l.id AS name FROM documents d JOIN lexicon l ON regexp_matches(d.text, '(^|[^A-Za-z])' || l.label || '([^A-Za-z]|$)')")
def blockers(s, d):
    texts = t(s, d, "documents").select(c("doc_id").alias("key"), "text")
    return mentions(texts, t(s, d, "lexicon").select(c("id").alias("name"), c("label").alias("phrase")), whole_words=True).select(c("key").alias("doc_id"), "name").distinct()
query("ev24_overlap", "SELECT person FROM (SELECT person FROM person_topics INTERSECT SELECT person FROM person_tags) WHERE NOT regexp_matches(person, '-[0-9]+$')")(lambda s, d: t(s, d, "person_topics").select("person").intersect(t(s, d, "person_tags").select("person")).where("NOT person RLIKE '-[0-9]+$'"))
