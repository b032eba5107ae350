"""The data-quality gates over the tables; each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.gates import Gate, run
from tidemark.operators.phrases import mentions
from tidemark.plans.common import GRAPH, N, V, edges, nodes
from tidemark.plans.registry import query
from tidemark.operators import graph as G
from tidemark.tables import table as t

c = F.col
GATES: list[Gate] = []


def gate(number: str, says: str, sql: str | None):
    """A gate is a query of two columns: subject and detail."""

    def add(f):
        GATES.append(Gate(number, says, f))
        return query(number, sql)(f)

    return add


def rows(df, subject, detail):
    return df.select(subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def simple(number: str, says: str, source: str, where_spark: str, where_sql: str, subject: str, detail: str, sql_detail: str | None = None):
    """A gate that is one predicate on one table."""

    def f(s, d):
        return rows(t(s, d, source).where(where_spark), F.expr(subject), F.expr(detail))

    gate(number, says, f"SELECT CAST({subject} AS VARCHAR) AS subject, CAST({sql_detail or detail} AS VARCHAR) AS detail FROM {source} WHERE {where_sql}")(f)


@gate("gt01_frozen_hash", "frozen copy exists and is primary", "SELECT DISTINCT id AS subject, CASE WHEN frozen IS NULL THEN 'no copy' WHEN sha256 IS NULL THEN 'no hash' WHEN sha256 <> sha256(frozen) THEN 'hash' ELSE 'state' END AS detail FROM sources WHERE frozen IS NULL OR sha256 IS NULL OR sha256 <> sha256(frozen) OR state <> 'primary'")
def frozen_hash(s, d):
    x = t(s, d, "sources")
    why = F.when(c("frozen").isNull(), "no copy").when(c("sha256").isNull(), "no hash").when(c("sha256") != F.sha2("frozen", 256), "hash").when(c("state") != "primary", "state")
    return rows(x.withColumn("w", why).where("w IS NOT NULL"), c("id"), c("w")).distinct()


simple("gt02_evidence_as_page", "no evidence is served as a page", "sources", "page LIKE '%.snapshot'", "page LIKE '%.snapshot'", "id", "page")


@gate("gt03_people_fields", "a person has name, page inside the site and a place in the index", "WITH i AS (SELECT DISTINCT unnest(from_json(CASE WHEN json_valid(people) THEN people END, '[\"VARCHAR\"]')) AS id FROM orgs) SELECT DISTINCT p.id AS subject, x.w AS detail FROM people p LEFT JOIN i ON i.id = p.id, LATERAL (SELECT unnest([CASE WHEN coalesce(p.name, '') = '' THEN 'name' END, CASE WHEN p.page IS NULL OR NOT starts_with(p.page, 'https://mare-alta.example/speakers/') THEN 'page' END, CASE WHEN i.id IS NULL AND p.org <> '' THEN 'index' END]) AS w) x WHERE p.id IS NOT NULL AND x.w IS NOT NULL")
def people_fields(s, d):
    index = t(s, d, "orgs").select(F.explode(F.from_json("people", "array<string>")).alias("id")).distinct().withColumn("i", F.lit(True))
    why = F.array(F.when(F.coalesce("name", F.lit("")) == "", "name"), F.when(c("page").isNull() | ~c("page").startswith("https://mare-alta.example/speakers/"), "page"), F.when(c("i").isNull() & (c("org") != ""), "index"))
    return rows(t(s, d, "people").where("id IS NOT NULL").join(index, "id", "left").select("id", F.explode(why).alias("w")).where("w IS NOT NULL"), c("id"), c("w")).distinct()


simple("gt04_target_as_result", "a target is not told as a result", "documents", "text RLIKE '(?i)(will reach|vai atingir|target of|meta de) [0-9]'", "regexp_matches(text, '(?i)(will reach|vai atingir|target of|meta de) [0-9]')", "doc_id", "kind")
simple("gt05_contacts", "no contact details in personal tables", "people", "concat_ws(' ', name, role, org) RLIKE '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+|[+]?[0-9]{3} [0-9]{3} [0-9]{3}'", "regexp_matches(concat_ws(' ', name, role, org), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+|[+]?[0-9]{3} [0-9]{3} [0-9]{3}')", "id", "role")
GT06_LONGEST = [('people', 'id', 'role', 160), ('people', 'id', 'org', 90), ('person_tags', 'person', 'matched', 40)]
gate("gt06_long_fields", "roles are no longer than 160 letters, organisations than 90, matched words than 40", "SELECT CAST(id AS VARCHAR) AS subject, 'role' AS detail FROM people WHERE length(role) > 160 UNION ALL SELECT CAST(id AS VARCHAR) AS subject, 'org' AS detail FROM people WHERE length(org) > 90 UNION ALL SELECT CAST(person AS VARCHAR) AS subject, 'matched' AS detail FROM person_tags WHERE length(matched) > 40")(
    lambda s, d: reduce(lambda a, b: a.unionByName(b), [rows(t(s, d, tb).where(F.length(col) > most), c(key), F.lit(col)) for tb, key, col, most in GT06_LONGEST])
)
simple("gt07_reason_words", "no reason for a removal", "nodes", "no_longer_listed = 1 AND role RLIKE '(?i)(because|porque|cancel)'", "no_longer_listed = 1 AND regexp_matches(role, '(?i)(because|porque|cancel)')", "id", "role")


REDERIVE = """WITH m AS (SELECT DISTINCT matched FROM person_tags WHERE matched IS NOT NULL), hit AS (SELECT m.matched, l.id AS tag FROM m JOIN lexicon l ON regexp_matches(lower(m.matched), lower(replace(replace(l.pattern, '\\b', ''), '\\w', '[a-z]')))),
stored AS (SELECT DISTINCT person, tag, matched FROM person_tags WHERE tag IS NOT NULL AND matched IS NOT NULL), derived AS (SELECT DISTINCT t.person, hit.tag, t.matched FROM person_tags t JOIN hit ON hit.matched = t.matched)
SELECT coalesce(a.person, b.person) AS subject, CASE WHEN a.tag IS NULL THEN 'not stored:' ELSE 'not derived:' END || coalesce(a.tag, b.tag) || ':' || coalesce(a.matched, b.matched) AS detail FROM stored a FULL JOIN derived b ON a.person = b.person AND a.tag = b.tag AND a.matched = b.matched WHERE a.tag IS NULL OR b.tag IS NULL"""


@gate("gt08_tags_rederive", "the tags stored are those the patterns derive, both ways", REDERIVE)
def tags_rederive(s, d):
    """Each distinct word meets the patterns once; stored and derived tags are compared by a full join."""
    x = t(s, d, "person_tags").where("matched IS NOT NULL")
    lex = t(s, d, "lexicon").select(c("id").alias("tag"), F.lower(F.replace(F.replace("pattern", F.lit("\\b"), F.lit("")), F.lit("\\w"), F.lit("[a-z]"))).alias("p"))
    hit = x.select("matched").distinct().join(lex, F.regexp_like(F.lower("matched"), c("p"))).select("matched", "tag")
    keys = ["person", "tag", "matched"]
    stored, derived = x.where("tag IS NOT NULL AND person IS NOT NULL").select(*keys).distinct(), x.drop("tag").where("person IS NOT NULL").join(hit, "matched").select(*keys).distinct()
    both = stored.withColumn("a", F.lit(1)).join(derived.withColumn("b", F.lit(1)), keys, "full").where("a IS NULL OR b IS NULL")
    return rows(both, c("person"), F.concat(F.when(c("a").isNull(), "not stored:").otherwise("not derived:"), "tag", F.lit(":"), "matched"))


@gate("gt09_names_verbatim", "a listed name stands in the frozen list", "SELECT DISTINCT p.id AS subject, p.snapshot AS detail FROM people p JOIN (SELECT id, max(frozen) AS f FROM sources WHERE page LIKE 'speakers/%' AND state = 'primary' GROUP BY id) s ON s.id = p.snapshot || '/speakers/' || p.id WHERE p.name IS NOT NULL AND s.f IS NOT NULL AND NOT contains(s.f, p.name)")
def names_verbatim(s, d):
    src = t(s, d, "sources").where("page LIKE 'speakers/%' AND state = 'primary'").groupBy(c("id").alias("sid")).agg(F.max("frozen").alias("f"))
    p = t(s, d, "people").where("id IS NOT NULL AND name IS NOT NULL").select("id", "name", "snapshot", F.concat("snapshot", F.lit("/speakers/"), "id").alias("sid")).distinct()
    return rows(p.join(src.where("f IS NOT NULL"), "sid").where(~F.contains("f", "name")), c("id"), c("snapshot")).distinct()


@gate("gt10_ontology", "an edge's verb is declared and its ends have the right types", f"WITH {GRAPH}, {V} SELECT e.id AS subject, CASE WHEN v.verb IS NULL THEN 'verb' WHEN a.type <> v.domain THEN 'domain' ELSE 'range' END AS detail FROM e LEFT JOIN v ON v.verb = e.verb JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE v.verb IS NULL OR a.type <> v.domain OR b.type <> v.range")
def ontology(s, d):
    n = nodes(s, d).select("id", "type")
    e = edges(s, d).select("id", "verb", "source", "target").join(G.verbs(s).select("verb", "domain", "range"), "verb", "left").join(n.select(c("id").alias("source"), c("type").alias("a")), "source").join(n.select(c("id").alias("target"), c("type").alias("b")), "target")
    why = F.when(c("domain").isNull(), "verb").when(c("a") != c("domain"), "domain").when(c("b") != c("range"), "range")
    return rows(e.withColumn("w", why).where("w IS NOT NULL"), c("id"), c("w"))


@gate("gt10_verbs", "no verb is its own inverse, names are distinct, templates have both slots", f"WITH {V} SELECT verb AS subject, reads AS detail FROM v WHERE verb = inverse OR NOT contains(reads, '{{s}}') OR NOT contains(reads, '{{o}}') OR verb IN (SELECT inverse FROM v) OR verb IN ('related_to', 'associated_with')")
def verbs(s, d):
    v = G.verbs(s)
    inv = v.select(c("inverse").alias("verb"), F.lit(True).alias("i")).distinct()
    return rows(v.join(inv, "verb", "left").where("verb = inverse OR NOT contains(reads, '{s}') OR NOT contains(reads, '{o}') OR i OR verb IN ('related_to', 'associated_with')"), c("verb"), c("reads"))


simple("gt12_write_scope", "a page lies in an allowed folder", "sources", "NOT page RLIKE '^(agenda|press|record|speakers)(/|$)'", "NOT regexp_matches(page, '^(agenda|press|record|speakers)(/|$)')", "id", "page")


@gate("gt13_quarantine", "the title of an excluded page stands on no reading page", "WITH x AS (SELECT DISTINCT id, substr(string_split(frozen, chr(10))[1], 1, 60) AS title FROM sources WHERE state = 'excluded' AND frozen IS NOT NULL AND length(string_split(frozen, chr(10))[1]) >= 30) SELECT DISTINCT x.id AS subject, CAST(d.doc_id AS VARCHAR) AS detail FROM x JOIN documents d ON contains(d.text, x.title)")
def quarantine(s, d):
    """Titles of excluded pages, however many, are looked for in one scan of the texts."""
    first = F.element_at(F.split("frozen", "\n"), 1)
    x = t(s, d, "sources").where("state = 'excluded' AND frozen IS NOT NULL").select(c("id").alias("name"), F.substring(first, 1, 60).alias("phrase"), F.length(first).alias("n")).where("n >= 30").select("name", "phrase").distinct()
    return rows(mentions(t(s, d, "documents").select(c("doc_id").alias("key"), "text"), x), c("name"), c("key")).distinct()


simple("gt14_notice", "a text that names the list links its page", "documents", "contains(text, 'lista de oradores') AND NOT contains(text, 'http')", "contains(text, 'lista de oradores') AND NOT contains(text, 'http')", "doc_id", "kind")
gate("gt15_titles_verbatim", "a session's label stands in the page it cites", f"WITH {N}, s AS (SELECT id, max(frozen) AS f FROM sources GROUP BY id) SELECT n.id AS subject, n.label AS detail FROM n JOIN s ON s.id = n.source WHERE n.type = 'Session' AND s.f IS NOT NULL AND NOT contains(s.f, n.label)")(
    lambda s, d: rows(nodes(s, d).where("type = 'Session'").select("id", "label", "source").join(t(s, d, "sources").groupBy(c("id").alias("source")).agg(F.max("frozen").alias("f")), "source").where("f IS NOT NULL AND NOT contains(f, label)"), c("id"), c("label"))
)
simple("gt16_path_agrees", "an id agrees with its snapshot and page", "sources", "id NOT IN (concat(snapshot, '/', page), concat(snapshot, '/attempt/', page))", "id NOT IN (snapshot || '/' || page, snapshot || '/attempt/' || page)", "id", "page")


def missing(number, says, left, key, right, rkey):
    """A reference that must resolve."""
    gate(number, says, f"SELECT DISTINCT CAST({key} AS VARCHAR) AS subject, '{left}' AS detail FROM {left} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {rkey} FROM {right} WHERE {rkey} IS NOT NULL)")(
        lambda s, d: rows(t(s, d, left).where(c(key).isNotNull()).select(c(key).alias("k")).distinct().join(t(s, d, right).select(c(rkey).alias("k")).distinct(), "k", "left_anti"), c("k"), F.lit(left))
    )


missing("gt17_citations", "every cited source is registered", "person_topics", "source", "sources", "id")
missing("gt17_tag_citations", "every source of a tag is registered", "person_tags", "source", "sources", "id")
simple("dq_published_without_text", "a published text has a text", "documents", "published IS NOT NULL AND (text IS NULL OR text = '')", "published IS NOT NULL AND (text IS NULL OR text = '')", "doc_id", "kind")
simple("dq_memos_citing_pages", "memos cite no frozen page", "documents", "kind = 'memo' AND contains(text, '/speakers/')", "kind = 'memo' AND contains(text, '/speakers/')", "doc_id", "section")
gate("gt20_sections", "every section has an article", "SELECT section AS subject, CAST(count(*) AS VARCHAR) AS detail FROM documents WHERE section IS NOT NULL GROUP BY section HAVING count(*) FILTER (kind = 'article') = 0")(lambda s, d: rows(t(s, d, "documents").where("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("n"), F.count_if(c("kind") == "article").alias("a")).where("a = 0"), c("section"), c("n")))
@gate("gt21_index", "index and table of persons agree both ways", "WITH a AS (SELECT DISTINCT unnest(from_json(CASE WHEN json_valid(people) THEN people END, '[\"VARCHAR\"]')) AS k FROM orgs), b AS (SELECT DISTINCT id AS k FROM people WHERE id IS NOT NULL AND org <> '') SELECT coalesce(a.k, b.k) AS subject, CASE WHEN a.k IS NULL THEN 'not indexed' ELSE 'not listed' END AS detail FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def gt21_index(s, d):
    a, b = t(s, d, "orgs").select(F.explode(F.from_json("people", "array<string>")).alias("k")), t(s, d, "people").where("org <> ''").select(c("id").alias("k"))
    both = a.where("k IS NOT NULL").distinct().withColumn("a", F.lit(1)).join(b.where("k IS NOT NULL").distinct().withColumn("b", F.lit(1)), "k", "full").where("a IS NULL OR b IS NULL")
    return rows(both, c("k"), F.when(c("a").isNull(), "not indexed").otherwise("not listed"))
gate("dq_unregistered_sources", "a node's source is registered", f"WITH {N} SELECT id AS subject, source AS detail FROM n WHERE source IS NOT NULL AND source NOT IN (SELECT id FROM sources WHERE id IS NOT NULL)")(lambda s, d: rows(nodes(s, d).where("source IS NOT NULL").select("id", "source").join(t(s, d, "sources").select(c("id").alias("source")).distinct(), "source", "left_anti"), c("id"), c("source")))
gate("dq_repeated_topics", "an item is linked at most once per person", "SELECT person AS subject, topic AS detail FROM person_topics WHERE topic IS NOT NULL GROUP BY person, topic, source HAVING count(*) > 1")(lambda s, d: rows(t(s, d, "person_topics").where("topic IS NOT NULL").groupBy("person", "topic", "source").count().where("count > 1"), c("person"), c("topic")))
simple("dq_outer_blanks", "a role is typed without outer blanks", "people", "role <> trim(role)", "role <> trim(role)", "id", "role")
missing("dq_persons_of_topics", "every person of a topic is known", "person_topics", "person", "people", "id")
simple("dq_loaded_before_published", "a document is loaded after it was published", "documents", "loaded < published", "loaded < published", "doc_id", "kind")
TEXT_COLUMNS = {"people": ["id", "name", "role", "org", "page", "linkedin", "snapshot"], "orgs": ["id", "name", "people"], "sources": ["id", "snapshot", "page", "publisher", "url", "frozen", "sha256", "retrieved", "state"], "nodes": ["id", "type", "label", "pack", "source", "role", "role_class", "org", "day", "time", "kind", "publisher", "published", "date", "url", "page"], "edges": ["id", "verb", "source", "target", "pack"], "lexicon": ["id", "type", "label", "pt", "pattern"]}
EMPTY_SQL = " UNION ALL ".join(f"SELECT '{col}' AS subject, '{tb}' AS detail FROM {tb} HAVING coalesce(max(length({col})), 0) = 0" for tb, cols in TEXT_COLUMNS.items() for col in cols)


@gate("gt33_empty_columns", "no column of text is empty throughout", EMPTY_SQL)
def empty_columns(s, d):
    """One pass per table finds the longest text of every column."""
    one = lambda tb, cols: t(s, d, tb).agg(*[F.coalesce(F.max(F.length(x)), F.lit(0)).alias(x) for x in cols]).select(F.inline(F.array(*[F.struct(F.lit(x).alias("subject"), F.lit(tb).alias("detail"), c(x).alias("n")) for x in cols])))
    return reduce(lambda a, b: a.unionByName(b), [one(tb, cols) for tb, cols in TEXT_COLUMNS.items()]).where("n = 0").select("subject", "detail")
simple("gt34_comment_language", "English texts hold no Portuguese function words", "documents", "lang = 'en' AND text RLIKE ' (que|não|uma|pelo|pela|são) '", "lang = 'en' AND regexp_matches(text, ' (que|não|uma|pelo|pela|são) ')", "doc_id", "source")
missing("dq_declared_tags", "every tag is declared", "person_tags", "tag", "lexicon", "id")
@gate("gt36_numbers", "no two gates share a number", "SELECT * FROM (VALUES ('gate', 'number')) v(subject, detail) WHERE false")
def numbers(s, d):
    """Numbers of gates that are used twice, over the list of gates itself."""
    listed = s.createDataFrame([(g.number, g.says) for g in GATES], "number string, says string")
    return rows(listed.groupBy("number").agg(F.count("*").alias("n")).where("n > 1"), c("number"), c("n"))
gate("dq_one_list_per_capture", "a capture has one list", "SELECT snapshot AS subject, CAST(count(DISTINCT sha256) AS VARCHAR) AS detail FROM sources WHERE page = 'speakers' AND state = 'primary' GROUP BY snapshot HAVING count(DISTINCT sha256) > 1")(lambda s, d: rows(t(s, d, "sources").where("page = 'speakers' AND state = 'primary'").groupBy("snapshot").agg(F.countDistinct("sha256").alias("n")).where("n > 1"), c("snapshot"), c("n")))
gate("dq_unmapped_third", "the number of unmapped words does not rise over a third", "SELECT 'person_tags' AS subject, CAST(count(*) FILTER (tag IS NULL) AS VARCHAR) AS detail FROM person_tags HAVING count(*) FILTER (tag IS NULL) > count(*) / 3")(lambda s, d: rows(t(s, d, "person_tags").agg(F.count_if(c("tag").isNull()).alias("a"), F.count("*").alias("b")).where("a > b / 3"), F.lit("person_tags"), c("a")))
gate("dq_orgs_without_node", "every organisation has a node", f"WITH {N} SELECT DISTINCT id AS subject, 'orgs' AS detail FROM orgs WHERE 'org:' || id NOT IN (SELECT id FROM n)")(lambda s, d: rows(t(s, d, "orgs").select("id", F.concat(F.lit("org:"), "id").alias("nid")).distinct().join(nodes(s, d).select(c("id").alias("nid")), "nid", "left_anti"), c("id"), F.lit("orgs")))
LATER = "p AS (SELECT page, snapshot, max(frozen) AS f FROM sources WHERE state = 'primary' AND frozen IS NOT NULL GROUP BY page, snapshot), l AS (SELECT page, snapshot, f, lag(f) OVER (PARTITION BY page ORDER BY snapshot) AS was FROM p)"


def later_copies(s, d):
    """(page, snapshot, f, was): each primary copy of a page with the copy before it."""
    p = t(s, d, "sources").where("state = 'primary' AND frozen IS NOT NULL").groupBy("page", "snapshot").agg(F.max("frozen").alias("f"))
    return p.withColumn("was", F.lag("f").over(Window.partitionBy("page").orderBy("snapshot"))).where("was IS NOT NULL")


@gate("gt42_lines", "the hash of a copy is current, and eight lines evenly taken from the copy before stand in it", f"WITH {LATER}, g AS (SELECT page, snapshot, f, list_filter(string_split(was, chr(10)), lambda x: trim(x) <> '') AS ls FROM l WHERE was IS NOT NULL), x AS (SELECT page, snapshot, f, unnest(list_transform(range(least(8, len(ls))), lambda i: ls[i * len(ls) // least(8, len(ls)) + 1])) AS line FROM g) SELECT DISTINCT snapshot || '/' || page AS subject, line AS detail FROM x WHERE NOT contains(f, line) UNION ALL SELECT DISTINCT id, 'hash' FROM sources WHERE sha256 <> sha256(frozen)")
def sampled_lines(s, d):
    lines = F.filter(F.split("was", "\n", -1), lambda x: F.trim(x) != "")
    x = later_copies(s, d).select("page", "snapshot", "f", lines.alias("ls")).where("size(ls) > 0").withColumn("line", F.expr("explode(transform(sequence(0, least(8, size(ls)) - 1), i -> ls[CAST(i * size(ls) div least(8, size(ls)) AS INT)]))"))
    stale = t(s, d, "sources").where("sha256 <> sha2(frozen, 256)")
    return rows(x.where(~F.contains("f", "line")), F.concat("snapshot", F.lit("/"), "page"), c("line")).distinct().unionByName(rows(stale, c("id"), F.lit("hash")).distinct())


@gate("gt44d_verbatim", "every quotation of 20 letters or more survives into the next copy of its page", f"WITH {LATER}, x AS (SELECT page, snapshot, f, unnest(regexp_extract_all(was, '«([^«»]{{20,}})»', 1)) AS quote FROM l WHERE was IS NOT NULL) SELECT DISTINCT snapshot || '/' || page AS subject, quote AS detail FROM x WHERE NOT contains(f, quote)")
def verbatim(s, d):
    x = later_copies(s, d).select("page", "snapshot", "f", F.explode(F.regexp_extract_all("was", F.lit("«([^«»]{20,})»"), F.lit(1))).alias("quote"))
    return rows(x.where(~F.contains("f", "quote")), F.concat("snapshot", F.lit("/"), "page"), c("quote")).distinct()
gate("gt44a_languages", "language codes are well formed and written in one way", "WITH l AS (SELECT lang, count(*) AS n, lower(trim(lang)) AS k FROM documents WHERE lang IS NOT NULL GROUP BY lang), w AS (SELECT k, count(*) AS ways FROM l GROUP BY k) SELECT lang AS subject, CASE WHEN NOT regexp_full_match(lang, '[a-z]{2}(-[A-Z]{2})?') THEN 'form' ELSE 'ways:' || ways END AS detail FROM l JOIN w USING (k) WHERE ways > 1 OR NOT regexp_full_match(lang, '[a-z]{2}(-[A-Z]{2})?')")(
    lambda s, d: (lambda l: rows(l.join(l.groupBy("k").agg(F.count("*").alias("ways")), "k").withColumn("bad", ~c("lang").rlike("^[a-z]{2}(-[A-Z]{2})?$")).where("ways > 1 OR bad"), c("lang"), F.when(c("bad"), "form").otherwise(F.concat(F.lit("ways:"), "ways"))))(t(s, d, "documents").where("lang IS NOT NULL").select("lang", F.lower(F.trim("lang")).alias("k")).distinct())
)
gate("gt44b_lengths", "a copy's key is the hash of its text, and the declared total of letters is the sum", "SELECT DISTINCT id AS subject, 'key' AS detail FROM sources WHERE sha256 <> sha256(frozen) UNION ALL SELECT coalesce(kind, ''), sum(n_chars) || ':' || sum(length(text)) FROM documents WHERE text IS NOT NULL GROUP BY kind HAVING sum(n_chars) <> sum(length(text))")(
    lambda s, d: rows(t(s, d, "sources").where("sha256 <> sha2(frozen, 256)"), c("id"), F.lit("key")).distinct().unionByName(rows(t(s, d, "documents").where("text IS NOT NULL").groupBy("kind").agg(F.sum("n_chars").alias("a"), F.sum(F.length("text")).alias("b")).where("a <> b"), F.coalesce("kind", F.lit("")), F.concat_ws(":", "a", "b")))
)
gate("gt44c_orphans", "texts without source are counted", "SELECT 'documents' AS subject, CAST(count(*) AS VARCHAR) AS detail FROM documents WHERE source IS NULL HAVING count(*) > 0")(lambda s, d: rows(t(s, d, "documents").where("source IS NULL").agg(F.count("*").alias("n")).where("n > 0"), F.lit("documents"), c("n")))
simple("gt44e_json", "JSON columns parse", "orgs", "people IS NOT NULL AND try_parse_json(people) IS NULL", "people IS NOT NULL AND NOT json_valid(people)", "id", "people")
gate("gt44f_trees", "every lexicon entry has both labels", "SELECT id AS subject, 'pt' AS detail FROM lexicon WHERE pt IS NULL OR pt = label")(lambda s, d: rows(t(s, d, "lexicon").where("pt IS NULL OR pt = label"), c("id"), F.lit("pt")))
gate("gt44g_coverage", "92 % of the words are mapped", "SELECT type AS subject, CAST(count(tag) * 100 // count(*) AS VARCHAR) AS detail FROM person_tags WHERE type IS NOT NULL GROUP BY type HAVING count(tag) * 100 // count(*) < 92")(lambda s, d: rows(t(s, d, "person_tags").where("type IS NOT NULL").groupBy("type").agg(F.expr("count(tag) * 100 div count(*)").alias("p")).where("p < 92"), c("type"), c("p")))
simple("gt45_reader_time", "no text tells the reader's day", "documents", "text RLIKE '(?i) (hoje|today|amanhã|tomorrow)[ ,.]'", "regexp_matches(text, '(?i) (hoje|today|amanhã|tomorrow)[ ,.]')", "doc_id", "kind")
simple("gt46_contacts", "no address in a text", "documents", "text RLIKE '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+'", "regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+')", "doc_id", "kind")
@gate("gi02_orgs_people", "organisations of cards and of the register agree both ways", "WITH a AS (SELECT DISTINCT name AS k FROM orgs WHERE name IS NOT NULL), b AS (SELECT DISTINCT org AS k FROM people WHERE org <> '') SELECT coalesce(a.k, b.k) AS subject, CASE WHEN a.k IS NULL THEN 'not registered' ELSE 'on no card' END AS detail FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def gi02_orgs_people(s, d):
    a, b = t(s, d, "orgs").select(c("name").alias("k")), t(s, d, "people").where("org <> ''").select(c("org").alias("k"))
    both = a.where("k IS NOT NULL").distinct().withColumn("a", F.lit(1)).join(b.where("k IS NOT NULL").distinct().withColumn("b", F.lit(1)), "k", "full").where("a IS NULL OR b IS NULL")
    return rows(both, c("k"), F.when(c("a").isNull(), "not registered").otherwise("on no card"))
gate("gi03_counts", "stored counts are the sizes", "SELECT id AS subject, bytes || ':' || octet_length(encode(frozen)) AS detail FROM sources WHERE bytes <> octet_length(encode(frozen)) UNION ALL SELECT CAST(doc_id AS VARCHAR), n_chars || ':' || length(text) FROM documents WHERE n_chars <> length(text)")(
    lambda s, d: rows(t(s, d, "sources").where("bytes <> octet_length(frozen)"), c("id"), F.concat_ws(":", "bytes", F.octet_length("frozen"))).unionByName(rows(t(s, d, "documents").where("n_chars <> length(text)"), c("doc_id"), F.concat_ws(":", "n_chars", F.length("text"))))
)
@gate("gi05_context", "a target isn't told as a result", "WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?s).{0,60}(?:has reached [0-9]|atingiu [0-9]|opened a |abriu em )')) AS told FROM documents WHERE text IS NOT NULL) SELECT CAST(doc_id AS VARCHAR) AS subject, told AS detail FROM x WHERE NOT regexp_matches(told, '(?s)target|meta|objetivo|plan|prev')")
def gi05_context(s, d):
    """Every mention with up to 60 letters before it, unless these put it right."""
    told = F.regexp_extract_all(F.lower("text"), F.lit("(?s).{0,60}(?:has reached [0-9]|atingiu [0-9]|opened a |abriu em )"), F.lit(0))
    return rows(t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(told).alias("told")).where(~c("told").rlike("(?s)target|meta|objetivo|plan|prev")), c("doc_id"), c("told"))
@gate("gi08_overclaim", "no overclaim without 'not' before it", "WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?s).{0,40}(?:pioneer|pioneira|pioneiro|first in the world)')) AS told FROM documents WHERE text IS NOT NULL) SELECT CAST(doc_id AS VARCHAR) AS subject, told AS detail FROM x WHERE NOT regexp_matches(told, '(?s)not |no |não |nem ')")
def gi08_overclaim(s, d):
    """Every mention with up to 40 letters before it, unless these put it right."""
    told = F.regexp_extract_all(F.lower("text"), F.lit("(?s).{0,40}(?:pioneer|pioneira|pioneiro|first in the world)"), F.lit(0))
    return rows(t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(told).alias("told")).where(~c("told").rlike("(?s)not |no |não |nem ")), c("doc_id"), c("told"))
GI10_LONGEST = [('nodes', 'id', 'label', 160), ('person_topics', 'person', 'topic', 80), ('person_tags', 'person', 'matched', 40)]
gate("gi10_long", "labels are no longer than 160 letters, topics than 80, matched words than 40", "SELECT CAST(id AS VARCHAR) AS subject, 'label' AS detail FROM nodes WHERE length(label) > 160 UNION ALL SELECT CAST(person AS VARCHAR) AS subject, 'topic' AS detail FROM person_topics WHERE length(topic) > 80 UNION ALL SELECT CAST(person AS VARCHAR) AS subject, 'matched' AS detail FROM person_tags WHERE length(matched) > 40")(
    lambda s, d: reduce(lambda a, b: a.unionByName(b), [rows(t(s, d, tb).where(F.length(col) > most), c(key), F.lit(col)) for tb, key, col, most in GI10_LONGEST])
)
TOPIC_ID = "'topic:' || trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-')"


@gate("gi16_topics", "edges and rows of topics agree both ways, and every topic has a speaker", f"WITH {GRAPH}, a AS (SELECT DISTINCT 'person:' || person AS p, {TOPIC_ID} AS q FROM person_topics WHERE topic IS NOT NULL AND person IS NOT NULL), b AS (SELECT DISTINCT source AS p, target AS q FROM e WHERE verb = 'speaks_on' AND source IS NOT NULL AND target IS NOT NULL) SELECT coalesce(a.p, b.p) AS subject, CASE WHEN a.p IS NULL THEN 'edge only:' ELSE 'row only:' END || coalesce(a.q, b.q) AS detail FROM a FULL JOIN b ON a.p = b.p AND a.q = b.q WHERE a.p IS NULL OR b.p IS NULL UNION ALL SELECT id, 'no speaker' FROM n WHERE type = 'Topic' AND id NOT IN (SELECT q FROM b)")
def topic_edges(s, d):
    slug = F.trim(F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "-"), F.lit("-"))
    a = t(s, d, "person_topics").where("topic IS NOT NULL AND person IS NOT NULL").select(F.concat(F.lit("person:"), "person").alias("p"), F.concat(F.lit("topic:"), slug).alias("q"), F.lit(1).alias("a")).distinct()
    b = edges(s, d).where("verb = 'speaks_on' AND source IS NOT NULL AND target IS NOT NULL").select(c("source").alias("p"), c("target").alias("q"), F.lit(1).alias("b")).distinct()
    both = a.join(b, ["p", "q"], "full").where("a IS NULL OR b IS NULL")
    lone = nodes(s, d).where("type = 'Topic'").select("id").join(b.select(c("q").alias("id")).distinct(), "id", "left_anti")
    return rows(both, c("p"), F.concat(F.when(c("a").isNull(), "edge only:").otherwise("row only:"), "q")).unionByName(rows(lone, c("id"), F.lit("no speaker")))
@gate("gi17_tags", "edges to tags and rows of tags agree both ways, and their words are there", f"WITH {GRAPH}, a AS (SELECT 'person:' || person AS p, 'tag:' || tag AS q, count(matched) = 0 AS bare FROM person_tags WHERE tag IS NOT NULL AND person IS NOT NULL GROUP BY ALL), b AS (SELECT DISTINCT source AS p, target AS q FROM e WHERE verb IN ('active_in', 'uses', 'advocates', 'offers') AND source IS NOT NULL AND target IS NOT NULL) SELECT coalesce(a.p, b.p) AS subject, CASE WHEN a.p IS NULL THEN 'edge only:' WHEN b.p IS NULL THEN 'row only:' ELSE 'no words:' END || coalesce(a.q, b.q) AS detail FROM a FULL JOIN b ON a.p = b.p AND a.q = b.q WHERE a.p IS NULL OR b.p IS NULL OR a.bare")
def tag_edges(s, d):
    a = t(s, d, "person_tags").where("tag IS NOT NULL AND person IS NOT NULL").groupBy(F.concat(F.lit("person:"), "person").alias("p"), F.concat(F.lit("tag:"), "tag").alias("q")).agg((F.count("matched") == 0).alias("a"))
    b = edges(s, d).where(c("verb").isin("active_in", "uses", "advocates", "offers") & c("source").isNotNull() & c("target").isNotNull()).select(c("source").alias("p"), c("target").alias("q"), F.lit(True).alias("b")).distinct()
    why = F.when(c("a").isNull(), "edge only:").when(c("b").isNull(), "row only:").when(c("a"), "no words:")
    return rows(a.join(b, ["p", "q"], "full").withColumn("w", why).where("w IS NOT NULL"), c("p"), F.concat("w", "q"))
simple("gv01_format", "snapshots are dates", "sources", "NOT snapshot RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'", "NOT regexp_full_match(snapshot, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "id", "snapshot")
simple("gv03_host", "a page lies on its publisher's host", "sources", "url IS NULL OR NOT url LIKE 'https://%'", "url IS NULL OR NOT url LIKE 'https://%'", "id", "coalesce(url, '')")
gate("dq_captures_without_list", "list and pages of speakers agree", "SELECT DISTINCT p.id AS subject, p.snapshot AS detail FROM people p WHERE p.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.snapshot = p.snapshot AND s.page = 'speakers')")(lambda s, d: rows(t(s, d, "people").where("id IS NOT NULL").select("id", "snapshot").distinct().join(t(s, d, "sources").where("page = 'speakers'").select("snapshot").distinct(), "snapshot", "left_anti"), c("id"), c("snapshot")))
simple("gv05_keys", "no key-shaped string", "documents", "text RLIKE '(sk|ghp|AKIA)[-_A-Za-z0-9]{16,}'", "regexp_matches(text, '(sk|ghp|AKIA)[-_A-Za-z0-9]{16,}')", "doc_id", "kind")
simple("dq_quote_pairs", "quotes open as often as they close", "documents", "length(replace(text, '«', '')) <> length(replace(text, '»', ''))", "length(replace(text, '«', '')) <> length(replace(text, '»', ''))", "doc_id", "kind")
simple("gv08_provenance", "a copy has a time and an address", "sources", "retrieved IS NULL OR url IS NULL", "retrieved IS NULL OR url IS NULL", "id", "state")


simple("dq_unsigned", "a published text has a house", "documents", "published IS NOT NULL AND source IS NULL", "published IS NOT NULL AND source IS NULL", "doc_id", "kind")
missing("dq_declared_tag_types", "every type of tag is declared", "person_tags", "type", "lexicon", "type")
missing("dq_unused_entries", "every entry of the lexicon is in use", "lexicon", "id", "person_tags", "tag")
simple("gi01_state", "a copy is primary or secondary and has a hash", "sources", "state NOT IN ('primary', 'secondary') OR sha256 IS NULL", "state NOT IN ('primary', 'secondary') OR sha256 IS NULL", "id", "state")
simple("gi04_motive", "no motive for a removal on a page", "documents", "text RLIKE '(?i)(withdrew because|desistiu porque|was removed because)'", "regexp_matches(text, '(?i)(withdrew because|desistiu porque|was removed because)')", "doc_id", "kind")
gate("gi06_anchors", "a node's page is a frozen page", f"WITH {N} SELECT id AS subject, page AS detail FROM n WHERE page IS NOT NULL AND page NOT IN (SELECT page FROM people WHERE page IS NOT NULL) AND page NOT IN (SELECT url FROM sources WHERE url IS NOT NULL)")(
    lambda s, d: rows(nodes(s, d).where("page IS NOT NULL").select("id", "page").join(t(s, d, "people").select("page").union(t(s, d, "sources").select("url")).where("page IS NOT NULL").distinct(), "page", "left_anti"), c("id"), c("page"))
)
POSTURE = ["privac|política de privacidade", "(?i)rights reserved|direitos reservados", "(?i)masthead|ficha técnica"]
gate("gi07_posture", "every piece carries the three statements", "SELECT DISTINCT s.id AS subject, p.p AS detail FROM sources s, (VALUES " + ", ".join(f"('{x}')" for x in POSTURE) + ") p(p) WHERE s.state = 'primary' AND s.frozen IS NOT NULL AND NOT regexp_matches(s.frozen, p.p)")(
    lambda s, d: rows(t(s, d, "sources").where("state = 'primary' AND frozen IS NOT NULL").select("id", "frozen", F.explode(F.array(*map(F.lit, POSTURE))).alias("p")).where(~F.regexp_like("frozen", c("p"))), c("id"), c("p")).distinct()
)


def resolved(number, says, verb, end):
    """Ends of edges of a verb that are no nodes."""
    gate(number, says, f"WITH {GRAPH} SELECT e.id AS subject, e.{end} AS detail FROM e WHERE verb = '{verb}' AND {end} IS NOT NULL AND {end} NOT IN (SELECT id FROM n)")(
        lambda s, d: rows(edges(s, d).where((c("verb") == verb) & c(end).isNotNull()).select(c("id").alias("e"), c(end).alias("id")).join(nodes(s, d).select("id"), "id", "left_anti"), c("e"), c("id"))
    )


resolved("gi09_cites", "an attestation cites a registered source", "attested_by", "target")
resolved("gi14_stage", "a session's stage is declared", "on_stage", "target")
simple("gi11_contacts", "no contact details in topics", "person_topics", "topic RLIKE '@|[0-9]{9}'", "regexp_matches(topic, '@|[0-9]{9}')", "person", "topic")
simple("gi12_notice", "a page of a person carries the privacy notice", "sources", "page LIKE 'speakers/%' AND frozen IS NOT NULL AND NOT frozen RLIKE '(?i)privac'", "page LIKE 'speakers/%' AND frozen IS NOT NULL AND NOT regexp_matches(frozen, '(?i)privac')", "id", "page")
gate("gi13_listed_or_marked", "a person is in the last list or marked", f"WITH {N}, l AS (SELECT DISTINCT 'person:' || id AS id FROM people WHERE snapshot = (SELECT max(snapshot) FROM people) AND id IS NOT NULL) SELECT id AS subject, 'unmarked' AS detail FROM n WHERE type = 'Person' AND coalesce(no_longer_listed, 0) <> 1 AND id NOT IN (SELECT id FROM l)")(
    lambda s, d: rows(nodes(s, d).where("type = 'Person' AND coalesce(no_longer_listed, 0) <> 1").join(t(s, d, "people").where("id IS NOT NULL").groupBy(F.concat(F.lit("person:"), "id").alias("id")).agg(F.max("snapshot").alias("m")).join(t(s, d, "people").agg(F.max("snapshot").alias("m")), "m", "left_semi").select("id"), "id", "left_anti"), c("id"), F.lit("unmarked"))
)
gate("gi15_excluded", "no source is excluded and registered", "SELECT id AS subject, 'both' AS detail FROM sources GROUP BY id HAVING count(*) FILTER (state = 'excluded') > 0 AND count(*) FILTER (state <> 'excluded') > 0")(lambda s, d: rows(t(s, d, "sources").groupBy("id").agg(F.count_if(c("state") == "excluded").alias("a"), F.count_if(c("state") != "excluded").alias("b")).where("a > 0 AND b > 0"), c("id"), F.lit("both")))
missing("dq_unregistered_orgs", "stored connections name known organisations", "people", "org", "orgs", "name")
simple("gv02_links", "a page's address ends in its page", "sources", "url IS NOT NULL AND NOT endswith(url, page)", "url IS NOT NULL AND NOT ends_with(url, page)", "id", "url")
simple("dq_pages_without_house", "every piece carries the house's line", "sources", "frozen IS NOT NULL AND publisher IS NOT NULL AND NOT contains(frozen, publisher)", "frozen IS NOT NULL AND publisher IS NOT NULL AND NOT contains(frozen, publisher)", "id", "publisher")
simple("gv09_watch_list", "no literal of the watch list", "documents", "contains(text, 'REDACTED')", "contains(text, 'REDACTED')", "doc_id", "kind")
simple("dq_build_folders", "no page lies in a build folder", "sources", "page LIKE 'build/%' OR page LIKE '.%'", "page LIKE 'build/%' OR page LIKE '.%'", "id", "page")


@query("gates_summary")
def gates_summary(s, d):
    """All gates with their violations."""
    return run(GATES, s, d)
