"""Encoding of texts with the ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary lies by default; the file is read by the driver and shipped to the tasks (under 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of the vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to so many bytes the rank array is scanned; longer pieces keep their ranks in a heap, with the same result.
SHORT = 128
#: Entries of a worker's cache of words before it starts anew.
CACHE = 400_000
#: Text that can't be cut at single spaces and line ends: other or repeated blanks, blanks at an end.
UNEVEN = re.compile(r"[^\S \n]|  | \n|\n |\n\n\n|\A\s|\s\Z")


class Encoder:
    """Ids of texts. Built once per worker from the lines of a rank file."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pieces = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.newline = self.ranks[b"\n"]
        outer = self

        class Chunks(dict):
            """Ids of a blank-free chunk, with or without the space before it."""

            def __init__(self, before: str):
                self.before = before

            def __missing__(self, chunk: str) -> tuple[int, ...]:
                if len(self) >= CACHE:
                    self.clear()
                ids = self[chunk] = tuple(outer.split(self.before + chunk))
                return ids

        self.first, self.later = Chunks(""), Chunks(" ")

    def split(self, text: str) -> list[int]:
        """By the pattern, then by ranks, each piece from the cache if it is there."""
        out: list[int] = []
        words = self.words
        for piece in self.pieces(text):
            ids = words.get(piece)
            if ids is None:
                if len(words) >= CACHE:
                    words.clear()
                ids = words[piece] = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
            out += ids
        return out

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        """Part boundaries and the rank of each adjacent pair lie in two arrays side by side.

        The least rank is found by a scan, the boundary inside that pair is
        deleted, and only the ranks of the two neighbouring pairs are read anew.
        """
        ranks, none = self.ranks, 1 << 30
        bounds = list(range(len(word) + 1))
        pair = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], none)
            if i:
                pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], none)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: bytes) -> list[int]:
        """The same merges in the same order for long pieces, n log n instead of n squared."""
        ranks, n = self.ranks, len(word)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != to:
                continue
            alive[j] = 0
            end[i], nxt[i] = to, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(word[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, text: str | None, out: array) -> None:
        """Append the ids of one text; none for null and empty."""
        if not text:
            return
        if UNEVEN.search(text):
            out.extend(self.split(text))
            return
        first, later, newline = self.first, self.later, self.newline
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            if line:
                chunks = iter(line.split(" "))
                out.extend(first[next(chunks)])
                for chunk in chunks:
                    out.extend(later[chunk])


_encoder: tuple[tuple[int, str], Encoder] | None = None


def _worker_encoder(key: int, rank_file: bytes, pattern: str) -> Encoder:
    global _encoder
    if _encoder is None or _encoder[0] != (key, pattern):
        _encoder = (key, pattern), Encoder(rank_file, pattern)
    return _encoder[1]


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): one row per row of `documents`, whole texts, no special tokens.

    Null and empty texts get an empty list; the strings of special tokens are
    ordinary text; a null key stays null; repeated rows stay repeated; extra
    columns are dropped. No shuffle: each task encodes what it reads.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    shipped, ident = spark.sparkContext.broadcast(content), zlib.crc32(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(ident, shipped.value, pattern)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                encoder.encode(t, ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
