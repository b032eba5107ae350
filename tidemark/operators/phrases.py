"""Which of many phrases stand in which texts: one scan with an automaton instead of a join of everything with everything."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many characters of phrases go into one automaton; more are cut into several, each of which scans the texts.
MAX_CHARS = 20_000_000
_built: dict[str, object] = {}


def mentions(texts: DataFrame, phrases: DataFrame, max_chars: int = MAX_CHARS, whole_words: bool = False) -> DataFrame:
    """(key, name, n): how often a phrase stands in a text, occurrences of one phrase not overlapping.

    `texts` is (key, text), `phrases` (name, phrase); both are compared as they
    are. Null texts and null or empty phrases are in no row; of several names
    with one phrase each has its row. `whole_words` takes only occurrences
    without an ASCII letter beside them. Texts aren't shuffled.
    """
    given = phrases.where(F.col("name").isNotNull() & (F.length("phrase") > 0)).select(F.col("name").cast("string").alias("name"), "phrase").distinct()
    size = given.agg(F.sum(F.length("phrase"))).first()[0] or 0
    parts = max(1, -(-size // max_chars))
    out = None
    for part in range(parts):
        here = given.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else given
        found = _scan(texts, here, whole_words)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(texts: DataFrame, phrases: DataFrame, whole_words: bool) -> DataFrame:
    names: dict[str, list[str]] = {}
    for r in phrases.toLocalIterator():
        names.setdefault(r.phrase, []).append(r.name)
    shipped, ident = texts.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if ident not in _built:
            _built.clear()
            a = ahocorasick.Automaton()
            for phrase in shipped.value:
                a.add_word(phrase, phrase)
            if len(a):
                a.make_automaton()
            _built[ident] = a
        a = _built[ident]
        letter = lambda x: x.isascii() and x.isalpha()
        for b in batches:
            rows, who, n = [], [], []
            for i, text in enumerate(b.column(1).to_pylist() if len(a) else ()):
                if not text:
                    continue
                seen: dict[str, list[int]] = {}  # end of the last occurrence counted, and their number
                for end, phrase in a.iter(text):
                    start = end - len(phrase) + 1
                    if whole_words and (letter(text[start - 1 : start]) or letter(text[end + 1 : end + 2])):
                        continue
                    at = seen.setdefault(phrase, [-1, 0])
                    if start > at[0]:
                        at[0], at[1] = end, at[1] + 1
                for phrase, (_, k) in seen.items():
                    for name in shipped.value[phrase]:
                        rows.append(i), who.append(name), n.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(who, pa.string()), pa.array(n, pa.int64())], ["key", "name", "n"])

    return texts.select("key", "text").mapInArrow(run, f"key {dict(texts.dtypes)['key']}, name string, n long")
