"""Pages of repeated keywords, link lists and product lines.

Bagged trees judge the segments (sentences, lines) of a page by their content
and links; a page's score is the share of its text in segments judged listed,
smoothed with the rate of its host. Labels for training come from a signal the
trees don't see: how far a page can be compressed, against other pages of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.operators.skew import salted_join
from tidemark.session import as_table

#: Function words of both languages; sentences hold them, lists of key phrases hardly do (fixed values).
FUNCTION_WORDS = frozenset(
    "the of and to in is for that with on as by from at its it an be are was were which who has have had this or not but says their into after before than will when no yes "
    "o os um uma e do da dos das em no na nos nas por para com que se ao aos pelo pela mais mas foi ser entre quem depois até já ainda não sem sobre seu sua num numa como".split()
) | {"à", "às", "é", "são"}
URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,7}\b(?:/\S*)?")
LINKED = re.compile(r"\.[a-z]{2}|://")
CUT = re.compile(r"(?<=[.!?…])\s+")
WORD = re.compile(r"[^\W_]+")
MARKS = ",/·|#•→-–—:;*"
SYMBOLS = "€$£%"
DIGITS = "0123456789"
CAPITAL = re.compile(r"[A-ZÀ-Ý]").findall
CLOSING = " )»\"”"
ENDS = (".", "!", "?", "…")
#: Pages below so many words are too small to be judged.
TINY = 15
#: Labelled pages used for training at most, half of each class, drawn by hash.
MAX_TRAINING = 4000
#: A page that compresses to less than the first share of what told text of its length compresses to is labelled
#: spam, from the second share on told; between lies no label.
SQUEEZED, LOOSE = 0.76, 0.84
#: Texts are compressed in windows of about so many bytes, so that long pages compress like short ones.
WINDOW = 1000
#: A word is repeated if it stands in the same or the last stretch of so many words.
STRETCH = 80
NAMES = [
    "words", "chars", "function", "distinct", "recent", "url_chars", "urls", "ended", "marks", "digits", "symbols", "capitals", "word_chars", "head_count", "first_mark",
    "page_urls", "prev_function", "next_function", "prev_recent", "next_recent", "prev_ended", "next_ended",
]


def segments_of(text: str) -> list[str]:
    """Sentences and lines of a text that aren't blank."""
    return [s for line in text.split("\n") if line and not line.isspace() for s in CUT.split(line) if s and not s.isspace()]


def features(text: str) -> tuple[int, list[int], list[tuple]]:
    """Number of words of a page, the size of each of its segments, and what NAMES says of a segment by itself."""
    segs = segments_of(text)
    bare, links = segs, [()] * len(segs)
    if LINKED.search(text) is not None:
        links = [URL.findall(s) if "." in s else () for s in segs]
        bare = [URL.sub(" ", s) if u else s for s, u in zip(segs, links)]
    words = [WORD.findall(s.lower()) for s in bare]
    heads: dict[str, int] = {}
    rows = []
    last: set = set()
    for line, (s, ws, u) in enumerate(zip(segs, words, links)):
        k, size = len(ws), len(s)
        k1 = k or 1
        telling = [w for w in ws if w not in FUNCTION_WORDS]
        recent = len(telling)
        for i in range(0, recent, STRETCH):
            now = set(telling[i : i + STRETCH])
            recent -= len(now - last)
            last = now if len(now) >= STRETCH // 4 or len(last) >= STRETCH else now | last
        head = ws[0] if ws else ""
        rows.append((
            k if k < 200 else 200, size if size < 2000 else 2000, (k - len(telling)) / k1, len(set(ws)) / k1, recent / (len(telling) or 1), sum(map(len, u)) / size if u else 0.0, len(u), s.rstrip(CLOSING).endswith(ENDS), sum(map(s.count, MARKS)) / k1,
            sum(map(s.count, DIGITS)) / size, sum(map(s.count, SYMBOLS)) / k1, len(CAPITAL(s)) / k1, sum(map(len, ws)) / k1, line - heads.get(head, -100) <= 8, not s.lstrip()[0].isalnum(),
        ))
        heads[head] = line
    return sum(map(len, words)), list(map(len, segs)), rows


def with_context(rows: list[tuple], page: list[int], sizes: list[int]) -> np.ndarray:
    """NAMES of the segments of many pages: those of features(), the share of links on the page, and of the neighbours."""
    x, of, w = np.array(rows, float), np.array(page), np.array(sizes, float)
    urls = np.bincount(of, x[:, NAMES.index("url_chars")] * w) / np.maximum(1, np.bincount(of, w))
    at = np.arange(len(of))
    before = np.where((at > 0) & (of[at - 1] == of), at - 1, at)
    after = np.minimum(at + 1, len(of) - 1)
    after = np.where(of[after] == of, after, at)
    near = [x[where, NAMES.index(name)] for name in ("function", "recent", "ended") for where in (before, after)]
    return np.column_stack([x, urls[of], *near])


def squeeze(text: str) -> tuple[int, float]:
    """Size of the windows of a text, and the compressed size of them all as a share of their size."""
    raw = text.encode("utf-8", "surrogatepass")
    step = max(1, -(-len(raw) // max(1, round(len(raw) / WINDOW))))
    return step, sum(len(zlib.compress(raw[i : i + step], 6)) for i in range(0, len(raw), step)) / max(1, len(raw))


#: A segment of so many bytes has a label of its own, others that of their page.
OWN_LABEL = 120


def told_share(step: float, line: tuple[float, float, float]) -> float:
    """What told text of such a window compresses to."""
    return line[0] + line[1] * (float(np.log2(step)) - line[2])


def segment_labels(segs: list[str], page: int, line: tuple[float, float, float]) -> list[int]:
    """Weak label of each segment: by its own compression if it is long enough (-1 if that says nothing), else that of the page."""
    out = []
    for s in segs:
        label = page
        if len(s) >= OWN_LABEL:
            step, share = squeeze(s)
            ratio = share / told_share(step, line)
            label = 1 if ratio <= SQUEEZED else 0 if ratio >= LOOSE else -1
        out.append(label)
    return out


def weak_labels(documents: DataFrame, doc: str, text: str) -> tuple[DataFrame, tuple[float, float, float]]:
    """(_doc, label): 1 spam, 0 told, of the pages that have a weak label; and the line of told text (level, slope, mean).

    What told text compresses to is a line in the logarithm of the window,
    fitted to the upper decile of all pages of each length (a bounded number of
    lengths, as windows are bounded); so even a corpus of mostly spam has a
    measure of told text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [squeeze(t) if t and len(WORD.findall(t)) >= TINY else (None, None) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.float64())], ["_doc", "step", "share"])

    pages = documents.select(doc, text).mapInArrow(run, f"_doc {dict(documents.dtypes)[doc]}, step int, share double").where("step IS NOT NULL")
    pages = as_table(pages.select("_doc", F.log2("step").alias("size"), "share"), "squeezed")
    decile = pages.groupBy(F.floor(F.col("size") * 2).alias("b")).agg(F.percentile_approx("share", 0.9, 1000).alias("q"), F.avg("size").alias("size"), F.count("*").alias("n")).collect()
    if not decile:
        return pages.select("_doc", F.lit(0).alias("label")).where("false"), (1.0, 0.0, 0.0)
    w, at, q = (np.array([float(r[k]) for r in decile]) for k in ("n", "size", "q"))
    mean, level = np.average(at, weights=w), np.average(q, weights=w)
    slope = np.average((at - mean) * (q - level), weights=w) / max(1e-9, np.average((at - mean) ** 2, weights=w))
    line = (float(level), float(slope), float(mean))
    ratio = F.col("share") / (F.lit(line[0]) + F.lit(line[1]) * (F.col("size") - F.lit(line[2])))
    return pages.select("_doc", F.when(ratio <= SQUEEZED, 1).when(ratio >= LOOSE, 0).alias("label")).where("label IS NOT NULL"), line


def fit(documents: DataFrame, doc: str, text: str, limit: int = MAX_TRAINING) -> tuple[DataFrame, trees.Bagged | None]:
    """Weak labels (_doc, label), and bagged trees on the segments of at most `limit` weakly labelled pages, half of each class.

    Long segments have labels of their own (a page may hold both kinds of
    text), short ones that of their page.
    """
    sure, line = weak_labels(documents, doc, text)
    sure = as_table(sure, "labels")
    picked = sure.where("label = 1").orderBy(F.xxhash64("_doc"), "_doc").limit(limit // 2).unionByName(sure.where("label = 0").orderBy(F.xxhash64("_doc"), "_doc").limit(limit // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, segs, of, sizes = [], [], [], []
            for i, (t, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                _, size, rows = features(t)
                segs += rows
                sizes += size
                of += [i] * len(size)
                label += segment_labels(segments_of(t), y, line)
            x = with_context(segs, of, sizes).tolist() if segs else []
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    texts = documents.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(picked), "_doc").select("_text", "label")
    rows = texts.mapInArrow(run, "label int, x array<double>").where("label >= 0").select("label", "x", F.xxhash64("x").alias("h"))
    # so many segments of each class at most, drawn by hash: a page may have any number of them
    drawn = [r for y in (0, 1) for r in rows.where(F.col("label") == y).orderBy("h", "x").limit(limit * 6).collect()]
    y = np.array([float(r.label) for r in drawn])
    if len(np.unique(y)) < 2:
        return sure, None
    x = np.array([r.x for r in drawn])
    return sure, trees.bag(x, y, depth=7)


def page_scores(documents: DataFrame, doc: str, text: str, host: str, model: trees.Bagged | None) -> DataFrame:
    """(_doc, _host, p): the share of each page's text in segments the trees judge listed; 0 for null, blank and tiny pages."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows)
            sizes, rows, of = [], [], []
            if shipped.value is not None:
                for i, t in enumerate(b.column(2).to_pylist()):
                    if t and not t.isspace():
                        n, size, x = features(t)
                        if n >= TINY:
                            sizes += size
                            rows += x
                            of += [i] * len(size)
            if rows:
                at, w = np.array(of), np.array(sizes, float)
                p = shipped.value.share(with_context(rows, of, sizes))
                total = np.bincount(at, w, b.num_rows)
                score = np.bincount(at, w * p, b.num_rows) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["_doc", "_host", "p"])

    kinds = dict(documents.dtypes)
    return documents.select(doc, host, text).mapInArrow(run, f"_doc {kinds[doc]}, _host {kinds[host]}, p double")


#: Weight of the host in log-odds before anything is known of it, and how sure that is (mean and deviation).
PRIOR, PRIOR_SD = 0.15, 0.1


def host_weight(joined: DataFrame, page: Column, host: Column) -> float:
    """Weight of the host's log-odds beside the page's, by the weak labels: logistic regression with one free factor.

    The pages reach the driver as counts of (label, page, host) in steps of a
    quarter of log-odds, a bounded number; the prior decides where pages alone
    tell the labels apart.
    """
    step = lambda c: F.round(F.least(F.greatest(c, F.lit(-7.0)), F.lit(7.0)) * 4)
    bins = joined.groupBy("label", step(page).alias("a"), step(host).alias("b")).count().collect()
    if not bins:
        return PRIOR
    y, a, b, n = (np.array([float(r[k]) for r in bins]) for k in ("label", "a", "b", "count"))
    a, b, w = a / 4, b / 4, PRIOR
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a + w * b)))
        slope = np.sum(n * b * (y - p)) - (w - PRIOR) / PRIOR_SD**2
        w = float(np.clip(w + slope / (np.sum(n * b * b * p * (1 - p)) + 1 / PRIOR_SD**2), 0.0, 1.0))
    return w


def spam_pages(documents: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc, host, score, page_score, host_rate, is_spam) for every page.

    The page score of the trees is smoothed with the spam rate of its host in
    log-odds, so that it decides near the border only. Null, empty, blank and
    tiny pages (under TINY words) are no spam; a null host has a rate of its
    own; repeated rows are judged alike; extra columns are ignored; without
    pages of both labels nothing is spam.
    """
    labels, model = fit(documents, doc, text)
    scored = page_scores(documents, doc, text, host, model).withColumn("_key", F.coalesce(F.col("_host").cast("string"), F.lit("\0")))
    scored = as_table(scored, "scores")
    # one spam page is added to a host's pages at the corpus rate of 1 in 20, so that small hosts stay near it
    rates = scored.groupBy("_key").agg(F.sum((F.col("p") >= 0.5).cast("double")).alias("_spam"), F.count("*").alias("_n"))
    joined = salted_join(scored, rates, ["_key"]).withColumn("host_rate", (F.col("_spam") + 1) / (F.col("_n") + 20))
    logit = lambda c: F.log(c / (1 - c))
    page = logit(F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999)))
    base = F.lit(float(np.log(1 / 19)))
    others = (F.col("_spam") - (F.col("p") >= 0.5).cast("double") + 1) / (F.col("_n") + 19)  # the host without the page itself
    weight = host_weight(joined.join(labels.groupBy("_doc").agg(F.min("label").alias("label")), "_doc"), page, logit(others) - base)
    score = 1 / (1 + F.exp(-(page + F.lit(weight) * (logit(F.col("host_rate")) - base))))
    out = joined.select(F.col("_doc").alias(doc), F.col("_host").alias(host), F.when(F.col("p") == 0, F.lit(0.0)).otherwise(score).alias("score"), F.col("p").alias("page_score"), "host_rate")
    return out.withColumn("is_spam", F.col("score") >= 0.5)
