"""Passages of held-out items inside corpus documents."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+").findall
MARKS = regex.compile(r"\p{M}+")
#: So many characters of items go into one automaton (a passage begins at every word, so its passages have some
#: dozen times as many); a larger item set is cut into several, each of which scans the corpus.
MAX_ITEM_CHARS = 8_000_000


def normal_words(text: str) -> list[str]:
    """Maximal runs of letters or digits after NFKD, removal of combining marks and lower-casing."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return WORDS(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of normal_words(text) lies in the text itself, as (start, end) in code points."""
    spans: list[list[int]] = []
    inside = False
    for i, c in enumerate(text):
        for d in c if c.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", c)).lower():
            if d.isalnum():
                if inside:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i, i + 1])
                inside = True
            elif not unicodedata.category(d).startswith("M"):
                inside = False
    return [(a, b) for a, b in spans]


def automaton_of(items: list[tuple[int, str]], words: int) -> ahocorasick.Automaton | None:
    """One automaton over all passages of `words` words of all items, each bounded by spaces."""
    owners: dict[str, set[int]] = defaultdict(set)
    for item, text in items:
        w = normal_words(text or "")
        for i in range(len(w) - words + 1):
            owners[f" {' '.join(w[i : i + words])} "].add(item)
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for passage, whose in owners.items():
        a.add_word(passage, (len(passage), tuple(sorted(whose))))
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str, words: int) -> list[tuple[int, int, int, int]]:
    """(item, start, end, matched words) per maximal run of overlapping passages of an item in a text."""
    flat = f" {' '.join(normal_words(text))} "
    at: dict[int, list[int]] = defaultdict(list)
    seen, count = 0, 0
    for end, (length, whose) in a.iter(flat):
        begin = end - length + 1
        count += flat.count(" ", seen, begin)  # words before the passage; ends only grow, begins may not
        seen = begin
        for item in whose:
            at[item].append(count)
    if not at:
        return []
    spans, out = word_spans(text), []
    for item, starts in at.items():
        starts = sorted(set(starts))
        run = starts[0]
        for a0, b0 in zip(starts, [*starts[1:], None]):
            if b0 is None or b0 > a0 + words:
                last = a0 + words
                out.append((item, spans[run][0], spans[last - 1][1], last - run) if len(spans) >= last else (item, None, None, last - run))
                run = b0
    return out


_built: dict[str, ahocorasick.Automaton | None] = {}


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 12, doc: str = "doc_id", text: str = "text", item: str = "item_id", max_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc, item, start, end, words): passages of at least `words` consecutive words of an item.

    `start` and `end` are code points of the original text. Null, empty and
    short texts hold nothing and short items are never found; repeated
    documents each get their rows; two items with a common passage are both
    reported. The items go to the tasks, the corpus is scanned once for each
    MAX_ITEM_CHARS of items, nothing is shuffled.
    """
    given = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(item, text).distinct()
    size = given.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-size // max_chars))
    out = None
    for part in range(parts):
        here = given.where(F.pmod(F.xxhash64(item), F.lit(parts)) == part) if parts > 1 else given
        found = _scan(documents, here, words, doc, text, item)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(documents: DataFrame, items: DataFrame, words: int, doc: str, text: str, item: str) -> DataFrame:
    """find_leaks() with the automaton of all of `items`."""
    spark = documents.sparkSession
    given = [(r[0], r[1]) for r in items.toLocalIterator()]
    shipped = spark.sparkContext.broadcast(given)
    ident = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ident not in _built:
            _built.clear()
            _built[ident] = automaton_of(shipped.value, words)
        a = _built[ident]
        for batch in batches:
            docs, found = [], []
            if a is not None:
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        h = hits(a, t, words)
                        docs += [i] * len(h)
                        found += h
            cols = [pa.array([h[k] for h in found], ty) for k, ty in enumerate((item_type, pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int32())), *cols], [doc, item, "start", "end", "words"])

    kinds = dict(items.dtypes)[item]
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds]
    return documents.select(doc, text).mapInArrow(run, f"`{doc}` {dict(documents.dtypes)[doc]}, `{item}` {kinds}, start int, `end` int, words int")
