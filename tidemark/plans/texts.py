"""Text, date, hash and JSON functions over the documents, pages and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.instants import iso_micros, utc_day
from tidemark.operators.graph import VERBS
from tidemark.plans.common import N, nodes
from tidemark.plans.registry import query
from tidemark.tables import table as t

c = F.col


def docs(s, d):
    return t(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")


#: Texts dressed as pages, so that the page functions run over the whole corpus.
PAGE = "'<html><style>p{}</style><h2>Bio</h2><p>' || text || '</p><h2>Topics</h2><ul><li>A &amp; B</li></ul><script>var x = 1;</script></html>'"


def pages(s, d):
    return docs(s, d).select("doc_id", F.expr(PAGE).alias("html"))


WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
STRIP = f"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\\s*>|<style.*?</style\\s*>|<svg.*?</svg\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{WS}', ' ', 'g'))"


@query("tx01_visible_text", f"SELECT doc_id, {STRIP} AS visible FROM (SELECT doc_id, {PAGE} AS html FROM documents WHERE text IS NOT NULL)")
def visible_text(s, d):
    """Without reading entities, which SQL can't; tests cover them."""
    return pages(s, d).select("doc_id", X.visible(c("html"), entities=False).alias("visible"))


query("tx01_entities")(lambda s, d: pages(s, d).select("doc_id", X.visible(c("html")).alias("visible")))




@query("tx02_largest_noscript", "SELECT doc_id, greatest(length(text), 3)::INT AS chars FROM documents WHERE text IS NOT NULL")
def largest_noscript_all(s, d):
    """Every text, escaped in the page and read again."""
    html = F.concat(F.lit("<noscript>abc</noscript><noscript>"), X.escaped(c("text")), F.lit("</noscript>"))
    blocks = F.regexp_extract_all(html, F.lit("(?is)<noscript>(.*?)</noscript>"), F.lit(1))
    read = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return docs(s, d).select("doc_id", F.array_max(F.transform(blocks, lambda x: F.length(read(x)))).alias("chars"))


query("tx03_stripped")(lambda s, d: pages(s, d).select("doc_id", X.stripped(c("html")).alias("text")))
query("tx04_between_headings", f"SELECT doc_id, regexp_extract(html, '(?s)<h2>Bio</h2>(.*?)<h2>', 1) AS bio FROM (SELECT doc_id, {PAGE} AS html FROM documents WHERE text IS NOT NULL)")(lambda s, d: pages(s, d).select("doc_id", F.regexp_extract("html", "(?s)<h2>Bio</h2>(.*?)<h2>", 1).alias("bio")))
query("tx05_first_match", "SELECT doc_id, CASE WHEN regexp_matches(text, '[Dd]ados [a-z]+') THEN substr(regexp_extract(text, '[Dd]ados [a-z]+'), 1, 40) END AS matched FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", X.first_match(c("text"), "[Dd]ados [a-z]+").alias("matched")))
query("tx06_slug", "SELECT DISTINCT name, CASE WHEN s = '' THEN 'sem-nome' ELSE s END AS slug FROM (SELECT name, trim(regexp_replace(lower(strip_accents(replace(name, chr(160), ' '))), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM orgs WHERE name IS NOT NULL)")(lambda s, d: t(s, d, "orgs").where("name IS NOT NULL").select("name", X.slug(c("name")).alias("slug")).distinct())
query("tx06_raw_slug", "SELECT DISTINCT name, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug FROM (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM orgs WHERE name IS NOT NULL)")(lambda s, d: t(s, d, "orgs").where("name IS NOT NULL").select("name", X.raw_slug(c("name")).alias("slug")).distinct())
query("tx07_normalise", f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{WS}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", X.collapse(X.nfc(c("text"))).alias("text")))
query("tx08_content_key", f"SELECT doc_id, substr(sha256(trim(regexp_replace(nfc_normalize(text), '{WS}', ' ', 'g'))), 1, 16) AS key FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", X.content_key(c("text")).alias("key")))
query("tx09_level")(lambda s, d: docs(s, d).select("doc_id", X.level(c("text")).alias("levelled")))


@query("tx10_locate_excerpt")
def locate(s, d):
    """The middle of every text looked up in the text itself (exact) and with its middle word gone (fragments)."""
    x = docs(s, d).select("doc_id", X.level(c("text")).alias("text"))
    n = F.length("text")
    part = lambda a, b: F.substring("text", (n * a).cast("int") + 1, (n * b).cast("int"))
    whole, cut = part(0.1, 0.8), F.concat(part(0.1, 0.35), part(0.55, 0.35))
    return x.select("doc_id", X.located(whole, c("text")).alias("a"), X.located(cut, c("text")).alias("b")).select("doc_id", c("a.kind").alias("whole"), c("b.kind").alias("cut"), c("b.pieces").alias("pieces"))


query("tx11_domain", "SELECT DISTINCT url, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^[^/?]*'), '^www\\.', '') AS domain FROM sources WHERE url IS NOT NULL")(lambda s, d: t(s, d, "sources").where("url IS NOT NULL").select("url", X.domain(c("url")).alias("domain")).distinct())
query("tx12_tracker", "SELECT DISTINCT url, regexp_matches(regexp_extract(lower(url), '://([^/?]*)', 1), '(^|\\.)(mare-alta\\.example|[a-z-]+\\.test)$') AS tracker FROM sources WHERE url IS NOT NULL")(lambda s, d: t(s, d, "sources").where("url IS NOT NULL").select("url", X.domain(c("url")).rlike(r"(?i)(^|\.)(mare-alta\.example|[a-z-]+\.test)$").alias("tracker")).distinct())
query("tx13_links", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, 'https?://[^\\s)\\]>\"]+'), lambda u: NOT contains(u, 'mare-alta.example')))), ' ') AS links FROM documents WHERE text IS NOT NULL")(
    lambda s, d: docs(s, d).select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r'https?://[^\s)\]>"]+'), F.lit(0)), lambda u: ~F.contains(u, F.lit("mare-alta.example"))))), " ").alias("links"))
)
#: Role classes by ordered patterns, the first match wins (fixed values of the formula).
ROLE_CLASSES = [("founder", "founder|fundador|ceo|chief executive"), ("investor", "investor|investidor|partner|capital"), ("adviser", "professor|advis|consult|counsel|research|investigador"), ("engineer", "engineer|engenheir|data|cto")]
query("tx14_role_class", "SELECT DISTINCT role, CASE " + " ".join(f"WHEN regexp_matches(lower(role), '{p}') THEN '{k}'" for k, p in ROLE_CLASSES) + " ELSE 'outro' END AS class FROM people WHERE role IS NOT NULL")(
    lambda s, d: (lambda w: t(s, d, "people").where("role IS NOT NULL").select("role").distinct().select("role", w.otherwise("outro").alias("class")))(reduce(lambda w, kp: w.when(F.lower("role").rlike(kp[1]), kp[0]), ROLE_CLASSES, F.when(F.lit(False), "")))
)
query("tx15_publisher", "SELECT DISTINCT publisher, trim(regexp_replace(trim(regexp_replace(publisher, '\\s*\\([^()]*\\)\\s*$', '')), '^.*—', '')) AS reduced FROM sources WHERE publisher IS NOT NULL")(lambda s, d: t(s, d, "sources").where("publisher IS NOT NULL").select("publisher", F.trim(F.regexp_replace(F.trim(F.regexp_replace("publisher", r"\s*\([^()]*\)\s*$", "")), "^.*—", "")).alias("reduced")).distinct())
query("tx16_escape", "SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') AS escaped FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")).alias("escaped")))
query("tx17_shorten", "SELECT DISTINCT url, CASE WHEN starts_with(url, 'https://mare-alta.example/') THEN 'p:' || substr(url, 27) ELSE url END AS short FROM sources WHERE url IS NOT NULL")(lambda s, d: t(s, d, "sources").where("url IS NOT NULL").select("url", F.when(c("url").startswith("https://mare-alta.example/"), F.concat(F.lit("p:"), F.substring("url", 27, 10000))).otherwise(c("url")).alias("short")).distinct())
query("tx18_clip", f"WITH {N} SELECT id, CASE WHEN length(label) > 40 THEN substr(label, 1, 39) || '…' ELSE label END AS label FROM n")(lambda s, d: nodes(s, d).select("id", X.clipped(c("label"), 40).alias("label")))
query("tx19_prefix", "SELECT DISTINCT id, substr(sha256, 1, 12) AS prefix FROM sources")(lambda s, d: t(s, d, "sources").select("id", F.substring("sha256", 1, 12).alias("prefix")).distinct())
query("tx20_concat", "SELECT person, 'tag' || ':' || tag AS item FROM person_tags")(lambda s, d: t(s, d, "person_tags").select("person", F.concat(F.lit("tag"), F.lit(":"), "tag").alias("item")))
query("tx22_translatable")(lambda s, d: docs(s, d).select("doc_id", X.translatable(c("text")).alias("translatable")))
query("tx23_generated")(lambda s, d: docs(s, d).select("doc_id", X.generated(c("text")).alias("generated")))
query("tx24_machine_fact", r"SELECT DISTINCT url AS text, regexp_matches(url, '(?i)^https?://\S+$') AS fact FROM sources WHERE url IS NOT NULL")(lambda s, d: t(s, d, "sources").where("url IS NOT NULL").select(c("url").alias("text"), X.machine_fact(c("url")).alias("fact")).distinct())




query("tx25_mask_and_fill", "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", (X.fill(X.mask(c("text")), X.masked_values(c("text"))) == c("text")).alias("same")))
#: The month and weekday rule of mask() for SQL, which can't look around: one pass takes every other of adjacent ones, the second the rest.
SQL_MONTH_DAY = f"'(?i)(^|[^\\pL\\pM_])(?:{X.MONTHS_DAYS})([^\\pL\\pM_]|$)', '\\1@\\2', 'g'"
query("tx25_mask", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, {SQL_MONTH_DAY}), {SQL_MONTH_DAY}), '[0-9]+', '#', 'g') AS mask FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", X.mask(c("text")).alias("mask")))
query("tx26_quotes", "SELECT doc_id, regexp_replace(text, '«[^»]*»', '¤', 'g') AS mask, len(regexp_extract_all(text, '«[^»]*»'))::INT AS quotes FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", F.regexp_replace("text", "«[^»]*»", "¤").alias("mask"), F.regexp_count("text", F.lit("«[^»]*»")).alias("quotes")))
query("tx27_looks_portuguese")(lambda s, d: docs(s, d).select("doc_id", X.looks_portuguese(c("text")).alias("portuguese")))
query("tx28_comment_language")(lambda s, d: docs(s, d).select("doc_id", X.comment_is_portuguese(c("text")).alias("portuguese")))
@query("tx30_marks", "SELECT doc_id, CASE WHEN coalesce(source, 'none') = coalesce(kind, 'none') THEN coalesce(source, 'none') ELSE coalesce(source, 'none') || ' ' || coalesce(kind, 'none') END AS marks FROM documents WHERE text IS NOT NULL")
def marks(s, d):
    """Citation marks of every text, dressed with three of which one repeats: distinct, in order."""
    mark = lambda x: F.concat(F.lit("[[fonte:"), F.coalesce(x, F.lit("none")), F.lit("]]"))
    dressed = F.concat_ws(" ", mark("source"), F.replace("text", F.lit("[["), F.lit("[ [")), mark("kind"), mark("source"))
    return t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all(dressed, F.lit(r"\[\[fonte:([^\]]*)\]\]"), F.lit(1))), " ").alias("marks"))
query("tx31_address", "SELECT doc_id, regexp_extract(text, '^(?:From|De): ([^ \\n]+)', 1) AS sender FROM documents WHERE kind = 'memo' AND text IS NOT NULL")(lambda s, d: t(s, d, "documents").where("kind = 'memo' AND text IS NOT NULL").select("doc_id", F.regexp_extract("text", r"^(?:From|De): ([^ \n]+)", 1).alias("sender")))
query("tx32_counts", f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> ''))::INT AS words, len(string_split(text, chr(10)))::INT AS lines, octet_length(encode(text))::INT AS bytes FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", X.words(c("text")).alias("words"), F.size(F.split("text", "\n", -1)).alias("lines"), F.octet_length("text").alias("bytes")))
STOP = ["the", "and", "for", "que", "com", "para", "uma", "dos", "das"]
query("tx33_tokens")(lambda s, d: docs(s, d).select("doc_id", F.filter(F.split(X.without_marks(F.lower("text")), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP)).alias("tokens")))
PARTICIPLE = "[^a-zà-ÿ]([a-zà-ÿ]{2,}(?:ad|id)[oa]s?)[^a-zà-ÿ]"
query("tx34_participles", f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{PARTICIPLE}', 1))), ' ') AS participles FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PARTICIPLE), F.lit(1)))), " ").alias("participles")))
query("tx37_safe_json", "SELECT doc_id, replace(text, '</', '<\\/') AS safe FROM documents WHERE text IS NOT NULL")(lambda s, d: docs(s, d).select("doc_id", F.replace("text", F.lit("</"), F.lit("<\\/")).alias("safe")))


#: Labels that one alternation is built of at most; more are refused, as they would be a corpus and no list.
MAX_LABELS = 20_000


@query("tx29_linked_entities")
def linked_entities(s, d):
    """First mention of each lexicon label in each text, longest labels first, outside markup."""
    found = t(s, d, "lexicon").select("label", "id").limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names = s.sparkContext.broadcast({r.label: r.id for r in found})

    def run(batches):
        import pandas as pd

        link = X.entity_linker(names.value)
        for b in batches:
            yield pd.DataFrame([(i, *hit) for i, x in zip(b["doc_id"], b["text"]) for hit in link(x)], columns=["doc_id", "name", "target", "position"])

    return docs(s, d).mapInPandas(run, "doc_id long, name string, target string, position int")


RENAMED = {v[0]: v[6] for v in VERBS}


@query("tx35_rename", f"WITH m(verb, name) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in RENAMED.items())}) SELECT e.id, 'if \"' || coalesce(m.name, e.verb) || '\" then ' || e.verb || ' or \"' || e.verb || '_x\"' AS line FROM edges e LEFT JOIN m USING (verb)")
def rename(s, d):
    """Quoted tokens renamed by a map, in lines that hold each verb quoted, bare and as part of a longer token."""
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    line = F.concat(F.lit('if "'), c("verb"), F.lit('" then '), c("verb"), F.lit(' or "'), c("verb"), F.lit('_x"'))
    return t(s, d, "edges").select("id", X.rename_quoted(line, names).alias("line"))


@query("tx36_relative_links", "WITH k AS (SELECT DISTINCT page FROM sources WHERE state = 'primary') SELECT DISTINCT s.page, 'site/' || s.page AS resolved, CASE WHEN s.page IN (SELECT page FROM k) THEN '../../' || s.page ELSE 'https://mare-alta.example/site/' || s.page END AS link FROM sources s")
def relative_links(s, d):
    """Links '../.././<page>/x/../' on a page in site/a/b resolved, and written again relative only if their target is known."""
    pages = t(s, d, "sources").select("page").distinct()
    known = t(s, d, "sources").where("state = 'primary'").select("page", F.lit(True).alias("known")).distinct()
    resolved = X.resolve(F.lit("site/a/b"), F.concat(F.lit("../.././"), "page", F.lit("/x/../")))
    x = pages.join(known, "page", "left").select("page", resolved.alias("resolved"), "known")
    return x.select("page", "resolved", F.when(c("known"), X.relative(F.lit("site/a/b"), c("resolved"))).otherwise(F.concat(F.lit("https://mare-alta.example/"), "resolved")).alias("link"))


# ---- dates
query("dt01_long_date", "SELECT doc_id, CAST(try_strptime(regexp_extract(text, '([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})', 1), '%-d %B %Y') AS DATE) AS day FROM documents WHERE text IS NOT NULL")(
    lambda s, d: docs(s, d).select("doc_id", F.try_to_date(F.nullif(F.regexp_extract("text", "([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})", 1), F.lit("")), "d MMMM yyyy").alias("day"))
)
query("dt02_days_between", "SELECT DISTINCT snapshot, date_diff('day', CAST(snapshot AS DATE), DATE '2026-11-10')::INT AS days FROM sources")(lambda s, d: t(s, d, "sources").select("snapshot", F.datediff(F.lit("2026-11-10").cast("date"), c("snapshot").cast("date")).alias("days")).distinct())
query("dt03_time_range", f"WITH {N} SELECT id, regexp_extract(time, '([0-9]{{1,2}}:[0-9]{{2}})', 1) AS start, regexp_extract(time, '[–-] ?([0-9]{{1,2}}:[0-9]{{2}})', 1) AS end FROM n WHERE type = 'Session' AND time IS NOT NULL")(lambda s, d: nodes(s, d).where("type = 'Session' AND time IS NOT NULL").select("id", F.regexp_extract("time", r"([0-9]{1,2}:[0-9]{2})", 1).alias("start"), F.regexp_extract("time", r"[–-] ?([0-9]{1,2}:[0-9]{2})", 1).alias("end")))
query("dt04_day_phrase", "SELECT DISTINCT snapshot, CASE date_diff('day', CAST(snapshot AS DATE), DATE '2026-09-21') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE date_diff('day', CAST(snapshot AS DATE), DATE '2026-09-21') || ' days ago' END AS phrase FROM sources")(
    lambda s, d: (lambda n: t(s, d, "sources").select("snapshot").distinct().select("snapshot", F.when(n == 0, "today").when(n == 1, "yesterday").otherwise(F.concat(n, F.lit(" days ago"))).alias("phrase")))(F.datediff(F.lit("2026-09-21").cast("date"), c("snapshot").cast("date")))
)
query("dt05_utc", "SELECT DISTINCT id, strftime(make_timestamp(epoch_us(retrieved::TIMESTAMPTZ)), '%Y-%m-%d') AS day, epoch_us(retrieved::TIMESTAMPTZ) AS us FROM sources")(lambda s, d: t(s, d, "sources").select("id", utc_day(iso_micros(c("retrieved"))).alias("day"), iso_micros(c("retrieved")).alias("us")).distinct())
query("dt06_versions", "SELECT DISTINCT snapshot, CAST(split_part(snapshot, '-', 1) AS INT) * 10000 + CAST(split_part(snapshot, '-', 2) AS INT) * 100 + CAST(split_part(snapshot, '-', 3) AS INT) > 20260601 AS newer FROM sources")(
    lambda s, d: t(s, d, "sources").select("snapshot").distinct().select("snapshot", (X.version(c("snapshot"), "-") > X.version(F.lit("2026-6-1"), "-")).alias("newer"))
)

# ---- hashing, JSON, arrays
query("mj01_sha256", "SELECT DISTINCT id, sha256(frozen) AS hash FROM sources WHERE frozen IS NOT NULL")(lambda s, d: t(s, d, "sources").where("frozen IS NOT NULL").select("id", F.sha2("frozen", 256).alias("hash")).distinct())
query("mj02_json_each", "SELECT o.id, x.person FROM orgs o, LATERAL (SELECT unnest(from_json(o.people, '[\"VARCHAR\"]')) AS person) x")(lambda s, d: t(s, d, "orgs").select("id", F.explode(F.from_json("people", "array<string>")).alias("person")))
POINTERS = {"people[1].id": ("ok", "a"), "people[<b>].n": ("ok", "2"), "people[7].id": ("no item 7 of people", None), "people[<zz>].n": ("no item zz of people", None), "other.id": ("no key other", None), "people[1].age": ("no key age", None), "total": ("ok", "3"), "people": ("not a value: people", None)}


@query("mj03_pointer", "SELECT DISTINCT id, pointer, reason, value FROM orgs, (VALUES " + ", ".join(f"('doc#{k}', '{r}', {'NULL' if v is None else repr(v)})" for k, (r, v) in POINTERS.items()) + ") v(pointer, reason, value) WHERE id IS NOT NULL")
def pointers(s, d):
    """Pointers file#key[number or <id>].key into a JSON document per organisation: what they reach, or why they don't."""
    docs_ = t(s, d, "orgs").where("id IS NOT NULL").select("id").distinct()
    item = lambda i, n: F.struct(F.lit(i).alias("id"), F.lit(n).alias("n"))
    doc = F.to_json(F.struct(F.array(item("x", 1), item("a", 3), item("b", 2)).alias("people"), F.lit(3).alias("total")))
    x = docs_.select("id", doc.alias("doc"), F.explode(F.array(*[F.lit("doc#" + p) for p in POINTERS])).alias("pointer"))
    return x.select("id", "pointer", X.point(c("doc"), c("pointer")).alias("r")).select("id", "pointer", "r.reason", "r.value")
query("mj04_arrays", "SELECT id, len(from_json(people, '[\"VARCHAR\"]'))::INT AS n, len(list_filter(from_json(people, '[\"VARCHAR\"]'), lambda p: starts_with(p, 'a')))::INT AS with_a FROM orgs WHERE people IS NOT NULL")(lambda s, d: t(s, d, "orgs").where("people IS NOT NULL").withColumn("p", F.from_json("people", "array<string>")).select("id", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x.startswith("a"))).alias("with_a")))
query("mj05_explode", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")(
    lambda s, d: t(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).where("key = 'k'")
)


@query("mj06_walk", "SELECT o.id, '[' || (x.i - 1) || ']' AS path, x.text FROM orgs o, LATERAL (SELECT unnest(from_json(o.people, '[\"VARCHAR\"]')) AS text, generate_subscripts(from_json(o.people, '[\"VARCHAR\"]'), 1) AS i) x")
def walk(s, d):
    """The strings of a nested value with their paths, a batch of documents at a time."""
    return t(s, d, "orgs").where("people IS NOT NULL").select("id", F.inline(X.walked(c("people")))).select("id", "path", "text")


query("mj07_names", f"WITH {N} SELECT id, 'label' AS field, label AS value FROM n WHERE label IS NOT NULL UNION ALL SELECT id, 'org', org FROM n WHERE org IS NOT NULL UNION ALL SELECT id, 'publisher', publisher FROM n WHERE publisher IS NOT NULL")(lambda s, d: nodes(s, d).select("id", F.inline(F.array(*[F.struct(F.lit(x).alias("field"), c(x).alias("value")) for x in ("label", "org", "publisher")]))).where("value IS NOT NULL"))
LUM = "CASE WHEN {x} / 255.0 <= 0.03928 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END"
query("mj08_contrast", "SELECT p_partkey, round(1.05 / (" + LUM.format(x="(p_partkey % 256)") + " + 0.05), 6) AS ratio FROM part")(lambda s, d: t(s, d, "part").select("p_partkey", F.round(F.expr("1.05D / (" + LUM.format(x="(p_partkey % 256)").replace("255.0", "255.0D").replace("12.92", "12.92D").replace("0.055", "0.055D").replace("1.055", "1.055D").replace("0.03928", "0.03928D") + " + 0.05D)"), 6).alias("ratio")))
query("mj09_node_size", "SELECT s_suppkey, round(greatest(22, least(80, 20 + 9 * sqrt(s_suppkey))), 6) AS size FROM supplier")(lambda s, d: t(s, d, "supplier").select("s_suppkey", F.round(F.greatest(F.lit(22.0), F.least(F.lit(80.0), 20 + 9 * F.sqrt("s_suppkey"))), 6).alias("size")))
@query("mj10_churn", "WITH p AS (SELECT page, snapshot, max(frozen) AS f FROM sources WHERE frozen IS NOT NULL GROUP BY page, snapshot), l AS (SELECT page, snapshot, string_split(f, chr(10)) AS now, lag(string_split(f, chr(10))) OVER (PARTITION BY page ORDER BY snapshot) AS was FROM p), x AS (SELECT page, snapshot, len(now)::INT AS lines, len(list_filter(list_distinct(now), lambda z: NOT list_contains(was, z)))::INT AS changed FROM l WHERE was IS NOT NULL) SELECT page, snapshot, lines, changed, changed * 100 // lines AS pct, lines >= 30 AND changed * 100 // lines >= 60 AS churned FROM x")
def churn(s, d):
    """Lines of a page that its capture before doesn't have, in percent; churned from 60 on if it has 30 lines."""
    x = t(s, d, "sources").where("frozen IS NOT NULL").groupBy("page", "snapshot").agg(F.max("frozen").alias("f")).select("page", "snapshot", F.split("f", "\n", -1).alias("now"))
    x = x.withColumn("was", F.lag("now").over(Window.partitionBy("page").orderBy("snapshot"))).where("was IS NOT NULL")
    x = x.select("page", "snapshot", F.size("now").alias("lines"), F.size(F.array_except("now", "was")).alias("changed")).withColumn("pct", F.expr("CAST(changed * 100 div lines AS INT)"))
    return x.withColumn("churned", (c("lines") >= 30) & (c("pct") >= 60))
ORG_SCHEMA = {"type": "object", "required": ["id", "name", "people"], "properties": {"name": {"type": "string", "minLength": 12}, "people": {"type": "array", "items": {"type": "string", "pattern": "^[a-m]"}}, "placeholder": {"enum": [0]}}}


@query("mj11_schema_check", """WITH o AS (SELECT DISTINCT id, name, people, placeholder FROM orgs WHERE id IS NOT NULL), p AS (SELECT id, name, placeholder, from_json(people, '["VARCHAR"]') AS a FROM o WHERE people IS NOT NULL)
SELECT DISTINCT * FROM (SELECT id, '/name' AS path, 'required' AS error FROM o WHERE name IS NULL UNION ALL SELECT id, '/people', 'required' FROM o WHERE people IS NULL UNION ALL SELECT id, '/name', 'minLength' FROM o WHERE length(name) < 12 UNION ALL SELECT id, '/placeholder', 'enum' FROM o WHERE placeholder <> 0
UNION ALL SELECT id, '/people/' || (i - 1), 'pattern' FROM (SELECT id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM p) WHERE NOT regexp_matches(v, '^[a-m]'))""")
def schema_check(s, d):
    """Every organisation as a JSON document against a schema: each error with its path."""
    doc = F.to_json(F.struct("id", "name", F.from_json("people", "array<string>").alias("people"), "placeholder"))
    return t(s, d, "orgs").where("id IS NOT NULL").select("id", F.inline(X.schema_errors(ORG_SCHEMA)(doc))).distinct()
@query("mj12_bounded_payload", "SELECT event_id, 'a=' || substr(repeat(event_type, 30), 1, 80) || ';b=1;c=2;d=3;e=4;f=' || user_id AS payload FROM events")
def bounded_payload(s, d):
    """Of eight extra keys the first six, strings cut to 80 letters."""
    given = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("a", F.repeat("event_type", 30)), ("b", F.lit(1)), ("c", F.lit(2)), ("d", F.lit(3)), ("e", F.lit(4)), ("f", c("user_id")), ("g", F.lit(6)), ("h", F.lit(7)))])
    kept = F.transform(F.slice(given, 1, 6), lambda x: F.concat(x["k"], F.lit("="), F.substring(x["v"], 1, 80)))
    return t(s, d, "events").select("event_id", F.array_join(kept, ";").alias("payload"))
