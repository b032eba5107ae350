"""Readers, writers, the console and streams as queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import graph as G
from tidemark.plans.common import N, nodes
from tidemark.plans.registry import query
from tidemark.plans.texts import WS
from tidemark.sources import readers as R
from tidemark.sources import sinks
from tidemark.sources.console import Console
from tidemark.streaming import captures as S
from tidemark.tables import table as t

c = F.col


def files(s, d):
    """The frozen copies as files."""
    return t(s, d, "sources").where("frozen IS NOT NULL").select(c("id").alias("path"), c("snapshot").alias("capture"), F.element_at(F.split("page", "/"), 1).alias("group"), "page", F.octet_length("frozen").alias("length"), F.lit("2026-01-01").cast("timestamp").alias("modified"), F.encode("frozen", "utf-8").alias("content")).distinct()


query("src01_captures", "SELECT DISTINCT snapshot AS capture FROM sources WHERE frozen IS NOT NULL")(lambda s, d: R.capture_dates(files(s, d)))
query("src02_newest_with_page", "SELECT max(snapshot) AS capture FROM sources WHERE page = 'speakers' AND frozen IS NOT NULL")(lambda s, d: R.newest_with(files(s, d), "speakers"))
query("src03_register", "SELECT DISTINCT id AS path, octet_length(encode(frozen))::INT AS bytes, sha256(frozen) AS sha256 FROM sources WHERE frozen <> '' AND NOT regexp_matches(substr(frozen, 1, 4000), 'Ocorreu algo de errado|404 Not Found|Page not found')")(lambda s, d: R.register(files(s, d))[0].select("path", "bytes", "sha256"))
query("src03_excluded", "SELECT DISTINCT id AS path, CASE WHEN frozen = '' THEN 'empty' ELSE 'error body' END AS why FROM sources WHERE frozen = '' OR regexp_matches(substr(frozen, 1, 4000), 'Ocorreu algo de errado|404 Not Found|Page not found')")(lambda s, d: R.register(files(s, d))[1].select("path", "why"))


@query("src05_load_tables", "SELECT name, people, CAST(placeholder AS VARCHAR) AS placeholder FROM orgs WHERE name IS NOT NULL")
def load_tables(s, d):
    """Organisations written as JSON documents and loaded again by a spec."""
    docs = t(s, d, "orgs").where("name IS NOT NULL").select(F.to_json(F.struct(F.array(F.struct("name", "people", "placeholder")).alias("orgs"))).alias("value"))
    spec = [{"name": "orgs", "file": "orgs.json", "path": "orgs", "columns": [{"name": "name"}, {"name": "people"}, {"name": "placeholder"}]}]
    return R.load_tables({"orgs.json": docs}, spec)["orgs"]


LI = "'<h1>x</h1>Confirmed speakers<ul><li id=\"' || id || '\"><h3>' || name || '</h3><p>' || role || '</p></li></ul>'"




@query("src08_speaker_cards", "SELECT DISTINCT id, trim(replace(name, '\\n', ' ')) AS name, nullif(trim(replace(role, '\\n', ' ')), '') AS role FROM people WHERE id IS NOT NULL AND name IS NOT NULL")
def speaker_cards_all(s, d):
    """Cards of every person with an id and a name, with or without a role, values escaped in the page."""
    p = t(s, d, "people").where("id IS NOT NULL AND name IS NOT NULL").select("id", X.escaped(c("name")).alias("name"), F.coalesce(X.escaped(c("role")), F.lit("")).alias("role"))
    return R.speaker_cards(p.select(c("id").alias("page"), F.expr(LI).alias("html"))).select("id", "name", "role").distinct()


query("src13_slug_gap", "SELECT topic AS slug, 'sitemap' AS side FROM (SELECT topic FROM person_topics WHERE topic IS NOT NULL EXCEPT SELECT label FROM nodes WHERE type = 'Topic') UNION ALL SELECT label, 'feed' FROM (SELECT label FROM nodes WHERE type = 'Topic' AND label IS NOT NULL EXCEPT SELECT topic FROM person_topics)")(
    lambda s, d: R.slug_gap(t(s, d, "person_topics").where("topic IS NOT NULL").select(c("topic").alias("slug")), t(s, d, "nodes").where("type = 'Topic' AND label IS NOT NULL").select(c("label").alias("slug")))
)
query("src16_inventory", "SELECT doc_id, octet_length(encode(text))::INT AS bytes, len(string_split(text, chr(10)))::INT AS lines FROM documents WHERE text IS NOT NULL")(lambda s, d: t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n", -1)).alias("lines")))
query("src19_bundles", "SELECT snapshot AS bundle, count(*) AS files, bool_and(coalesce(sha256 = sha256(frozen), false)) AS ok FROM (SELECT DISTINCT id, snapshot, sha256, frozen FROM sources) GROUP BY snapshot")(
    lambda s, d: R.verified_bundles(t(s, d, "sources").select("id", "snapshot", "sha256", "frozen").distinct().select(F.xxhash64("id", "sha256", "frozen").alias("file"), c("snapshot").alias("bundle"), "sha256"), t(s, d, "sources").select("id", "sha256", "frozen").distinct().select(F.xxhash64("id", "sha256", "frozen").alias("file"), F.encode("frozen", "utf-8").alias("content")))
)
ROBOTS = [("/", True), ("/record/", False), ("/record/*-1*", True), ("/press/*5$", False)]


@query("src20_robots", "SELECT DISTINCT '/' || page AS path, CASE WHEN regexp_matches('/' || page, '^/record/.*-1') THEN true WHEN regexp_matches('/' || page, '^/press/.*5$') THEN false WHEN starts_with(page, 'record/') THEN false ELSE true END AS allowed FROM sources")
def robots(s, d):
    return R.robots_allowed(t(s, d, "sources").select(F.concat(F.lit("/"), "page").alias("path")).distinct(), s.createDataFrame(ROBOTS, "rule string, allow boolean"))


query("src21_coverage", "SELECT DISTINCT p.id, p.name AS note, s.f AS first FROM (SELECT id, max_by(name, snapshot || name) AS name FROM people WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id) p JOIN (SELECT page, max_by(string_split(frozen, chr(10))[1], id) AS f FROM sources WHERE frozen IS NOT NULL GROUP BY page) s ON s.page = 'speakers/' || p.id")(
    lambda s, d: t(s, d, "people").where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.max_by("name", F.concat("snapshot", "name")).alias("note")).join(t(s, d, "sources").where("frozen IS NOT NULL AND page LIKE 'speakers/%'").groupBy(F.expr("substring(page, 10)").alias("id")).agg(F.max_by(F.element_at(F.split("frozen", "\n"), 1), "id").alias("first")), "id")
)
query("src22_commit_log", "SELECT id AS hash, verb AS date, source AS author, target AS subject FROM edges WHERE source IS NOT NULL AND target IS NOT NULL")(lambda s, d: R.commit_log(t(s, d, "edges").where("source IS NOT NULL AND target IS NOT NULL").select(F.concat_ws("\t", "id", "verb", "source", "target").alias("value"))))
query("snk03_manifest", "SELECT DISTINCT id AS path, octet_length(encode(frozen))::INT AS bytes, sha256(frozen) AS sha256 FROM sources WHERE frozen IS NOT NULL")(lambda s, d: sinks.manifest(files(s, d)))
query("snk04_collection_index", f"WITH {N} SELECT type AS collection, count(*) AS items FROM n GROUP BY type")(lambda s, d: nodes(s, d).groupBy(c("type").alias("collection")).agg(F.count("*").alias("items")))


@query("qy01_console", "SELECT type, count(*) AS n FROM lexicon GROUP BY type")
def console(s, d):
    con = Console(s)
    con.register(d, ["lexicon"])
    return con.run("SELECT type, count(*) AS n FROM lexicon GROUP BY type; SELECT 1")


query("sm01_bounded_batches", "SELECT event_id, date_trunc('minute', ts) AS batch FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 80")(lambda s, d: S.bounded_batches(t(s, d, "events")))
@query("sm03_only_new", "SELECT DISTINCT id FROM people WHERE id IS NOT NULL AND snapshot = (SELECT max(snapshot) FROM people) AND id NOT IN (SELECT id FROM people WHERE id IS NOT NULL AND snapshot < (SELECT max(snapshot) FROM people))")
def only_new(s, d):
    p = t(s, d, "people").where("id IS NOT NULL")
    last = p.agg(F.max("snapshot").alias("m"))
    x = p.crossJoin(F.broadcast(last))
    return S.only_new(x.where("snapshot = m").select("id"), x.where("snapshot < m").select("id"))


query("ext_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")(lambda s, d: S.tumbling(t(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))).withColumn("start", c("start").cast("timestamp_ntz")))
query("ext_session_windows", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, count(*) AS n, min(ts) AS start FROM b GROUP BY user_id, k")(
    lambda s, d: S.sessions(t(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))).select("user_id", "n", c("start").cast("timestamp_ntz").alias("start"))
)




LINE = f"trim(regexp_replace(replace(label, '\\n', ' ') || ' (Main Stage)', '{WS}', ' ', 'g'))"


@query("src09_agenda", f"WITH {N} SELECT DISTINCT substr(trim(regexp_replace(regexp_replace({LINE}, '\\s*\\([^()]*\\)', '', 'g'), '([.!?]) .*$', '\\1')), 1, 140) AS title, CASE WHEN day IS NULL THEN 'day' ELSE trim(day) END AS day FROM n WHERE type = 'Session' AND label IS NOT NULL")
def agenda_all(s, d):
    """Every session with a label, escaped; the reader's cuts of a title (brackets, first sentence, length) are in the SQL."""
    n = nodes(s, d).where("type = 'Session' AND label IS NOT NULL")
    html = F.concat(F.lit("<h2>"), X.escaped(F.coalesce("day", F.lit("day"))), F.lit("</h2><ul><li>9:00–9:30 — "), X.escaped(c("label")), F.lit(" (Main Stage)</li></ul>"))
    return R.agenda_rows(n.select(c("id").alias("page"), html.alias("html"))).select("title", "day").distinct()


def feeds(s, d, name):
    item = F.concat(F.lit("<item><guid>"), "id", F.lit("</guid><title><![CDATA["), "label", F.lit("]]></title><link>l</link><description>d</description></item>"))
    return nodes(s, d).where("type = 'Session' AND label IS NOT NULL AND NOT label RLIKE '[&<>]'").select(name.alias("feed"), item.alias("xml"))


ITEMS = "FROM n WHERE type = 'Session' AND label IS NOT NULL AND NOT regexp_matches(label, '[&<>]')"


def feeds_all(s, d, name):
    item = F.concat(F.lit("<item><guid>"), X.escaped(c("id")), F.lit("</guid><title><![CDATA["), X.escaped(c("label")), F.lit("]]></title><link>l</link><description>d</description></item>"))
    return nodes(s, d).where("type = 'Session' AND label IS NOT NULL").select(name.alias("feed"), item.alias("xml"))


ALL_ITEMS = "FROM n WHERE type = 'Session' AND label IS NOT NULL"
query("src10_rss_items", f"WITH {N} SELECT id AS guid, regexp_replace(regexp_replace(label, '\\s+$', ''), '^\\s+', '') AS title {ALL_ITEMS}")(lambda s, d: R.rss_items(feeds_all(s, d, F.lit("all"))).select("guid", F.regexp_replace(F.regexp_replace("title", r"\s+$", ""), r"^\s+", "").alias("title")))
query("src11_feed_events", f"WITH {N} SELECT id AS guid, CASE WHEN kind IS NULL THEN 'none' ELSE kind END AS category {ALL_ITEMS}")(lambda s, d: R.feed_events(feeds_all(s, d, F.lit("all")), feeds_all(s, d, F.coalesce("kind", F.lit("none")))).select("guid", F.array_join("categories", ",").alias("category")))


@query("src12_posts", "SELECT doc_id, coalesce(source, 'fallback') AS author FROM documents WHERE text IS NOT NULL")
def posts(s, d):
    """Documents dressed as posts: JSON-LD where there is a source, a <meta> else."""
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.struct(c("source").alias("name")).alias("author"))), F.lit('</script><meta name="author" content="fallback">'))
    return R.blog_posts(t(s, d, "documents").where("text IS NOT NULL").select(c("doc_id").alias("page"), ld.alias("html"))).select(c("page").alias("doc_id"), "author")


@query("src14_mail", "SELECT doc_id, nullif(regexp_replace(regexp_extract(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))[1], '(?im)^From:[ \\t]*(.*)$', 1), '^ +| +$', '', 'g'), '') AS sender FROM documents WHERE kind = 'memo' AND text IS NOT NULL")
def read_mail(s, d):
    """Every memo as a message; one without the header has no sender."""
    memos = t(s, d, "documents").where("kind = 'memo' AND text IS NOT NULL").select(F.concat(F.lit("box/entrada/"), "doc_id").alias("path"), c("text").alias("value"))
    return R.mail(memos).select(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "sender")
@query("src15_cards", "SELECT doc_id, coalesce(nullif(trim(section), ''), CASE WHEN doc_id % 2 = 0 THEN 'Heading ' || doc_id END, nullif(trim(regexp_extract(text, '(?m)^# (.*)$', 1)), ''), 'Card ' || doc_id) AS title FROM documents WHERE text IS NOT NULL")
def read_cards(s, d):
    """Every text as a card: front matter with the section as title, every other one with a heading before its text."""
    title = F.coalesce(F.concat(F.lit("titulo: "), F.nullif(F.trim("section"), F.lit("")), F.lit("\n")), F.lit(""))
    heading = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("# Heading "), "doc_id", F.lit("\n"))).otherwise("")
    card = F.concat(F.lit("---\nsource: s\n"), title, F.lit("---\n"), heading, "text")
    x = t(s, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("x/card-"), "doc_id", F.lit(".md")).alias("path"), card.alias("value"))
    return R.cards(x).select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "title")
query("src17_articles", "SELECT a.section AS folder, a.n AS articles, m.n AS memos FROM (SELECT section, count(*) AS n FROM documents WHERE kind = 'article' AND section IS NOT NULL GROUP BY section) a LEFT JOIN (SELECT section, count(*) AS n FROM documents WHERE kind = 'memo' GROUP BY section) m ON m.section = a.section")(
    lambda s, d: R.articles(
        t(s, d, "documents").where("kind = 'article' AND section IS NOT NULL").groupBy(c("section").alias("folder")).agg(F.count("*").alias("articles"), F.max("published").alias("date"), F.max("doc_id").alias("slug")),
        t(s, d, "documents").where("kind = 'memo'").groupBy(c("section").alias("folder")).agg(F.count("*").alias("memos")),
        t(s, d, "documents").where("kind = 'digest'").groupBy(c("section").alias("folder")).agg(F.count("*").alias("digests")),
        t(s, d, "documents").where("kind = 'session'").groupBy(c("section").alias("folder")).agg(F.count("*").alias("sessions")),
    ).select("folder", "articles", "memos")
)




#: Blanks that Python's strip() takes off.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("src18_pdf", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'), '^{BLANK}|{BLANK}$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def pdf_all(s, d):
    """Every text dressed as a PDF, escaped or coded with a ToUnicode map, each other one compressed, and read again."""
    import pandas as pd

    from tidemark.sources.pdf import dressed

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["doc_id"].astype(str), "content": [dressed(x, i % 2 == 0) for i, x in zip(b["doc_id"], b["text"])]})

    x = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, "path string, content binary")
    return R.pdf_text(x).select(c("path").cast("bigint").alias("doc_id"), "text")


query("src23_collection", "SELECT doc_id AS n, len(string_split(text, chr(10)))::INT AS lines, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")(
    lambda s, d: (lambda x: R.collection(x.select("n", "path"), x.select("path", "value")).select("n", "lines", "sha256"))(t(s, d, "documents").where("text IS NOT NULL").select(c("doc_id").alias("n"), c("doc_id").cast("string").alias("path"), c("text").alias("value")))
)
query("tx21_literals", "SELECT DISTINCT 'literal' AS kind, label AS value FROM lexicon UNION SELECT 'literal', pt FROM lexicon")(lambda s, d: t(s, d, "lexicon").select(F.lit("literal").alias("kind"), F.explode(F.array("label", "pt")).alias("value")).distinct())
