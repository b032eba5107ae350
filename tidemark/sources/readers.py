"""Readers: dated captures, pages, feeds, mail, cards and specs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

CAPTURE = r"(?:^|/)(\d{4}-\d{2}-\d{2})/"
#: Bodies of failed captures (fixed values); looked for in the first 4000 letters.
FAILURES = "Ocorreu algo de errado|404 Not Found|Page not found"


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of files of 0 bytes, which the binary reader passes over; from the file system's listing."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listing = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while listing.hasNext():
        s = listing.next()
        if s.getLen() == 0:
            found.append((s.getPath().toString(), s.getModificationTime()))
    return spark.createDataFrame(found, "path string, ms long").select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def files(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """(path, capture, group, page, length, modified, content) of frozen files below <folder>/<date>/<group>/<page>."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)
    raw = raw.select("path", "modificationTime", "length", "content").unionByName(empty_files(spark, folder).where(~F.col("path").rlike(r"/[._][^/]*$")))
    tail = F.regexp_extract("path", r"\d{4}-\d{2}-\d{2}/(.*)$", 1)
    return raw.select("path", F.regexp_extract("path", CAPTURE, 1).alias("capture"), F.element_at(F.split(tail, "/"), 1).alias("group"), F.regexp_replace(tail, r"\.[a-z]+$", "").alias("page"), "length", F.col("modificationTime").alias("modified"), "content")


def capture_dates(files_: DataFrame) -> DataFrame:
    """(capture), ascending: folders that are dates."""
    return files_.where(F.col("capture").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("capture").distinct().orderBy("capture")


def newest_with(files_: DataFrame, page: str) -> DataFrame:
    """(capture): the newest capture that has the page, not the newest folder."""
    return files_.where(F.col("page") == page).agg(F.max("capture").alias("capture"))


def register(files_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The register of good files, and the list of excluded ones with the reason."""
    head = F.substring(F.col("content").cast("string"), 1, 4000)
    why = F.when(F.col("length") == 0, "empty").when(head.rlike(FAILURES), "error body")
    x = files_.select("path", "capture", "group", "page", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved"), why.alias("why"))
    return x.where("why IS NULL").drop("why"), x.where("why IS NOT NULL")


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or no rows where the file is missing."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def load_tables(documents: dict[str, DataFrame], spec: list[dict]) -> dict[str, DataFrame]:
    """Tables by spec {name, file, path, columns: [{name, from}]} out of JSON texts (one column `value` each).

    `path` is the dotted way to an array; each element is a row. Scalars become
    strings, booleans 1 or 0, lists and objects JSON text, missing paths null.
    """
    out = {}
    for t in spec:
        rows = documents[t["file"]].select(F.explode(F.expr(f"try_variant_get(parse_json(value), '$.{t['path']}', 'array<variant>')")).alias("e"))
        cols = []
        for col in t["columns"]:
            v = F.try_variant_get("e", "$." + col.get("from", col["name"]), "variant")
            kind = F.schema_of_variant(v)
            text = F.when(kind == "BOOLEAN", F.when(v.cast("boolean"), "1").otherwise("0")).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v)).when(kind == "VOID", None).otherwise(v.cast("string"))
            cols.append(F.when(v.isNotNull(), text).alias(col["name"]))
        out[t["name"]] = rows.select(*cols)
    return out


def _fields(item: Column, tag: str) -> Column:
    body = F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return X.unescape(F.trim(F.regexp_replace(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


def speaker_cards(pages: DataFrame, marker: str = "Confirmed speakers") -> DataFrame:
    """(page, position, id, name, role, org, link, linkedin): list items with an id behind the marker."""
    after = F.when(F.contains("html", F.lit(marker)), F.substring_index("html", marker, -1)).otherwise("")
    items = pages.select("page", F.posexplode(F.regexp_extract_all(after, F.lit(r'(?s)<li[^>]*\bid="[^"]*"[^>]*>.*?</li>'), F.lit(0))).alias("position", "li"))
    p = F.regexp_extract_all("li", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return items.select(
        "page", "position", F.regexp_extract("li", r'\bid="([^"]*)"', 1).alias("id"), X.stripped(F.regexp_extract("li", r"(?s)<h3[^>]*>(.*?)</h3>", 1)).alias("name"),
        F.nullif(X.stripped(F.get(p, F.lit(0))), F.lit("")).alias("role"), F.nullif(X.stripped(F.get(p, F.lit(1))), F.lit("")).alias("org"),
        F.nullif(F.regexp_extract("li", r'<a[^>]*href="((?!https?://[^"]*linkedin)[^"]*)"', 1), F.lit("")).alias("link"), F.nullif(F.regexp_extract("li", r'href="(https?://[^"]*linkedin[^"]*)"', 1), F.lit("")).alias("linkedin"),
    )


def agenda_rows(pages: DataFrame, longest: int = 140) -> DataFrame:
    """(page, day, start, end, when_, stage, format, title): rows below day headings, split at the dash, first of a (title, day) wins."""
    days = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<h2[^>]*>.*?(?=<h2|\z)"), F.lit(0))).alias("d", "block"))
    rows = days.select("page", "d", X.stripped(F.regexp_extract("block", r"(?s)<h2[^>]*>(.*?)</h2>", 1)).alias("day"), F.posexplode(F.regexp_extract_all("block", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("k", "li"))
    x = rows.withColumn("line", X.collapse(X.stripped(F.col("li")))).where("length(line) > 0")
    # the time range holds a dash of its own: the row is split at the dash with blanks around it
    x = x.withColumn("when_", F.regexp_extract("line", r"^(.*?)\s+[–—]\s+(.*)$", 1)).withColumn("what", F.regexp_extract("line", r"^(.*?)\s+[–—]\s+(.*)$", 2)).where("what <> ''")
    title = F.regexp_replace(F.regexp_replace("what", r"\s*\([^()]*\)", ""), r"(?<=[.!?]) .*$", "")
    out = x.select(
        "page", "d", "k", "day", F.regexp_extract("when_", r"(\d{1,2}:\d{2})", 1).alias("start"), F.regexp_extract("when_", r"\d{1,2}:\d{2}\s*[–—-]\s*(\d{1,2}:\d{2})", 1).alias("end"), "when_",
        F.nullif(F.coalesce(F.nullif(F.trim(F.regexp_replace("when_", r"[\d:–—,\s-]+", " ")), F.lit("")), F.regexp_extract("what", r"\(([^()]*)\)", 1)), F.lit("")).alias("stage"),
        F.nullif(F.regexp_extract("what", r"\([^()]*\).*\(([^()]*)\)", 1), F.lit("")).alias("format"), F.substring(F.trim(title), 1, longest).alias("title"),
    )
    first = Window.partitionBy("page", "title", "day").orderBy("d", "k")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "d", "k")


def rss_items(feeds: DataFrame) -> DataFrame:
    """(feed, guid, title, link, description) of every item, CDATA taken off, entities read."""
    items = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item>.*?</item>"), F.lit(0))).alias("i"))
    return items.select("feed", *[_fields(F.col("i"), x).alias(x) for x in ("guid", "title", "link", "description")])


def feed_events(feeds: DataFrame, categories: DataFrame) -> DataFrame:
    """(guid, title, when_, date, where_, categories): events with the feeds of categories that hold their guid."""
    e = rss_items(feeds)
    of = rss_items(categories).groupBy("guid").agg(F.sort_array(F.collect_set("feed")).alias("categories"))
    when = F.nullif(X.stripped(F.regexp_extract("description", r"(?s)<strong>When:</strong>(.*?)(?:<br|</p|$)", 1)), F.lit(""))
    where = F.nullif(X.stripped(F.regexp_extract("description", r"(?s)<strong>Where:</strong>(.*?)(?:<br|</p|$)", 1)), F.lit(""))
    day = F.try_to_date(F.nullif(F.regexp_extract(when, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), F.lit("")), "d MMMM yyyy")
    return e.join(of, "guid", "left").select("guid", "title", when.alias("when_"), day.alias("date"), where.alias("where_"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def blog_posts(pages: DataFrame) -> DataFrame:
    """(page, title, published, author, links): JSON-LD of a posting (object or list) with <meta> as fallback."""
    ld = F.try_parse_json(F.regexp_extract("html", r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1))
    get = lambda p: F.nullif(F.coalesce(F.try_variant_get(ld, f"$.{p}", "string"), F.try_variant_get(ld, f"$[0].{p}", "string")), F.lit(""))
    meta = lambda p: F.nullif(X.unescape(F.regexp_extract("html", rf'<meta[^>]*(?:property|name)="{p}"[^>]*content="([^"]*)"', 1)), F.lit(""))
    links = F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", r"(?s)<article.*?</article>", 0), F.lit(r'href="(https?://[^"]+)"'), F.lit(1)))
    return pages.select("page", F.coalesce(get("headline"), meta("og:title")).alias("title"), F.coalesce(get("datePublished"), meta("article:published_time")).alias("published"), F.coalesce(get("author.name"), meta("author")).alias("author"), links.alias("links"))


def slug_gap(sitemap: DataFrame, feed: DataFrame) -> DataFrame:
    """(slug, side): slugs that only one of sitemap and feed has."""
    a, b = sitemap.select("slug").distinct(), feed.select("slug").distinct()
    return a.join(b, "slug", "left_anti").withColumn("side", F.lit("sitemap")).unionByName(b.join(a, "slug", "left_anti").withColumn("side", F.lit("feed")))


def mail(messages: DataFrame) -> DataFrame:
    """(path, place, box, sender, to, subject, date, id, in_reply_to, body): headers unfolded, state is the folder."""
    text = F.replace("value", F.lit("\r\n"), F.lit("\n"))
    head = F.regexp_replace(F.substring_index(text, "\n\n", 1), r"\n[ \t]+", " ")
    body = F.when(F.contains(text, F.lit("\n\n")), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise("")
    h = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    parts = F.split("path", "/")
    return messages.select("path", F.element_at(parts, -2).alias("place"), F.try_element_at(parts, F.lit(-3)).alias("box"), h("From").alias("sender"), h("To").alias("to"), h("Subject").alias("subject"), h("Date").alias("date"), h("Message-ID").alias("id"), h("In-Reply-To").alias("in_reply_to"), body.alias("body"))


def cards(documents: DataFrame) -> DataFrame:
    """(path, title, meta, body) of Markdown with front matter; title: front matter, first heading, else the file's name."""
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    meta = F.when(front != "", F.str_to_map(F.regexp_replace(front, r":[ \t]+", ":"), F.lit("\n"), F.lit(":"))).otherwise(F.create_map().cast("map<string,string>"))
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    name = F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(?:\.[a-z]+)?$", 1), "[-_]+", " "))
    title = F.coalesce(F.nullif(F.trim(F.try_element_at(meta, F.lit("titulo"))), F.lit("")), F.nullif(F.trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1)), F.lit("")), name)
    return documents.select("path", title.alias("title"), meta.alias("meta"), body.alias("body"))


def inventory(documents: DataFrame, categories: list[tuple[str, str]]) -> DataFrame:
    """(path, title, category, bytes, lines, words); the category is that of the first prefix in the list that fits."""
    cat = F.when(F.lit(False), "")
    for prefix, name in categories:
        cat = cat.when(F.col("path").startswith(prefix) | F.col("path").contains("/" + prefix), name)
    return cards(documents).join(documents.select("path", "value"), "path").select("path", "title", cat.otherwise("other").alias("category"), F.octet_length("value").alias("bytes"), F.size(F.split("value", "\n", -1)).alias("lines"), X.words(F.col("value")).alias("words"))


def articles(records: DataFrame, checks: DataFrame, provenance: DataFrame, prose: DataFrame) -> DataFrame:
    """Article folders with what belongs to them, newest first."""
    return records.join(checks, "folder", "left").join(provenance, "folder", "left").join(prose, "folder", "left").orderBy(F.desc("date"), F.desc("slug"))


def verified_bundles(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """(bundle, files, ok): a bundle with one missing or wrong file is rejected whole."""
    real = content.select("file", F.sha2("content", 256).alias("_sha"))
    good = F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False))
    return manifest.join(real, "file", "left").groupBy("bundle").agg(F.count("*").alias("files"), F.bool_and(good).alias("ok"))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, allowed): the longest matching rule wins, Allow wins ties, no rule allows; '*' and '$' as in robots files."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("rule", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*"))
    r = rules.select("rule", "allow", pattern.alias("p"))
    hit = paths.crossJoin(r).where(F.regexp_like("path", F.col("p")))
    best = hit.groupBy("path").agg(F.max(F.struct(F.length("rule").alias("n"), "allow")).alias("b"))
    return paths.join(best, "path", "left").select("path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def coverage(notes: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, note, title): notes with the newest frozen copy; notes without one are left out; titles end at 140 letters."""
    newest = copies.groupBy("id").agg(F.max_by("html", "capture").alias("html"))
    return notes.join(newest, "id").select("id", "note", F.substring(X.stripped(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), 1, 140).alias("title"))


def commit_log(lines: DataFrame) -> DataFrame:
    """(hash, date, author, subject) of tab-separated lines; malformed lines are dropped."""
    p = F.split("value", "\t", 4)
    return lines.where(F.size(p) >= 4).select(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("hash", "date", "author", "subject"))])


def collection(order: DataFrame, documents: DataFrame) -> DataFrame:
    """(n, path, lines, sha256) of an ordered list of files; a missing file is an error."""
    x = order.join(documents, "path", "left")
    value = F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("missing file: "), "path"))).otherwise(F.col("value"))
    return x.select("n", "path", F.size(F.split(value, "\n", -1)).alias("lines"), F.sha2(value, 256).alias("sha256"))


def pdf_text(files_: DataFrame) -> DataFrame:
    """(path, text): text of simple PDFs: Flate or plain streams, ToUnicode maps with hex codes, Tj and TJ in order of the file.

    Encrypted files and fonts without a map give what can be read as Latin text.
    """
    import pandas as pd

    from tidemark.sources.pdf import text_of

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [text_of(x) for x in b["content"]]})

    return files_.select("path", "content").mapInPandas(run, "path string, text string")
