"""Variant spellings of names: which spellings denote the same organisation.

A name is read as kind, field, number and its proper words ("stems"); stems are
matched by walking tries with Levenshtein automata, partners in any order. The
known words of kinds and fields are a prior only: names without any of them are
matched by all their words, those that many different names share being weak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import as_table

#: Fields of houses: the wordings that mean the same field (fixed values); the first is its name.
FIELDS = {
    "labs": "labs laboratorios laboratories lab lbs",
    "systems": "systems sistemas system",
    "software": "software sw",
    "networks": "networks redes network",
    "technologies": "technologies tecnologias technology tecnologia tech",
    "robotics": "robotics robotica",
    "analytics": "analytics analitica analise",
    "health": "health saude hlth",
    "energy": "energy energia enrg",
    "foods": "foods alimentar alimentos fds alimentacao food",
    "logistics": "logistics logistica",
    "mobility": "mobility mobilidade",
    "security": "security seguranca",
    "insurance": "insurance seguros seguro",
    "finance": "finance financas financeira financas",
    "education": "education educacao",
    "consulting": "consulting consultoria",
    "studio": "studio estudio",
    "capital": "capital",
    "ventures": "ventures capital-de-risco venture",
    "management": "management gestao",
    "innovation": "innovation inovacao",
    "data": "data dados",
    "computing": "computing computacao",
    "language": "language linguagem",
}
#: Kinds other than companies: wordings (fixed values).
KINDS = {
    "university": "universidade university univ uni u",
    "institute": "instituto institute inst",
    "association": "associacao association assoc ass",
    "foundation": "fundacao foundation",
    "municipality": "camara municipality municipio cm cmunicipal cam",
    "fund": "fundo",
}
#: Words that say nothing about who is meant: legal forms, articles, connectives (fixed values).
NOISE = frozenset("lda sa ltd inc llc gmbh sgps unipessoal portugal fp scr the company limitada plc corp co de da do dos das of for em sociedade consultores associados advogados superior sup higher municipal polo crescimento".split())
LEGAL = frozenset("lda sa ltd inc llc gmbh sgps unipessoal portugal company corp plc limitada grupo gr group".split())
FIELD_OF = {w: f for f, ws in FIELDS.items() for w in ws.split()}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
NUMBERS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "1": 1, "2": 2, "3": 3}
COMPANY = sorted({"labs", "systems", "software", "networks", "technologies", "robotics", "analytics", "health", "energy", "foods", "logistics", "mobility", "security", "insurance", "finance", "education", "consulting", "studio", "capital", "ventures"})
#: Initials of institutes: the letter after IS is the field's in the first language (fixed values).
INITIALS = {"e": "energy", "i": "innovation", "r": "robotics", "l": "language", "c": "computing", "d": "data", "g": "management", "s": "health"}

PLACE = re.compile(r"\(.*?\)|\s-\s*[Pp][Oo][Ll][Oo]\s.*$")
PARTNER = re.compile(r"&|\+|\be\b|\band\b", re.I)
SPLIT = re.compile(r"(?<=[a-zà-ý])(?=[A-ZÀ-Ý][a-zà-ý])")
#: Errors allowed in a stem by its length.
LONG, SHORT = 8, 5


def bound(length: int) -> int:
    return 2 if length >= LONG else 1 if length >= SHORT else 0


def fold(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()


class Trie:
    """Strings by their letters, searched with a Levenshtein automaton."""

    def __init__(self, words: Iterator[str] | list[str] = (), both: bool = True):
        self.root: dict = {}
        self.back: dict | None = {} if both else None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        for root, letters in ((self.root, word), (self.back, word[::-1])):
            if root is None:
                continue
            node = root
            for c in letters:
                node = node.setdefault(c, {})
            node[""] = word

    def near(self, word: str, k: int) -> set[str]:
        """Stored words within k insertions, deletions and substitutions.

        Of at most k errors at most k // 2 lie in the first half of `word`, or
        at most (k - 1) // 2 in the second: one walk down the words from the
        front and one down the words read backwards find every case, each with
        few errors allowed where the trie is broad.
        """
        if not word:
            return set()
        half = len(word) // 2
        out = self._walk(self.root, word, k, half, k // 2)
        if k:
            out |= self._walk(self.back, word[::-1], k, len(word) - half, (k - 1) // 2)
        return out

    @staticmethod
    def _walk(root: dict, word: str, k: int, half: int, early: int) -> set[str]:
        """Walk with a Levenshtein automaton whose state is the sparse row of distances.

        A row holds (letters of `word` read, errors) up to k errors, up to
        `early` before letter `half`; a branch dies with an empty row.
        """
        n = len(word)
        out: set[str] = set()

        def closed(row: dict[int, int]) -> list[tuple[int, int]]:
            """The row with letters of `word` left out, in order of letters read."""
            i = min(row)
            done = []
            e = k + 1
            while i <= n:
                e = min(e + 1, row.get(i, k + 1))
                if e > k or (e > early and i < half):
                    e = k + 1
                    later = [x for x in row if x > i]
                    if not later:
                        break
                    i = min(later)
                    continue
                done.append((i, e))
                i += 1
            return done

        stack = [(root, closed({0: 0}))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if state[-1][0] == n:
                        out.add(child)
                    continue
                row: dict[int, int] = {}
                for i, e in state:
                    if e < k and row.get(i, k) > e:
                        row[i] = e + 1
                    if i < n:
                        e += word[i] != c
                        if e <= k and row.get(i + 1, k + 1) > e:
                            row[i + 1] = e
                if row and (nxt := closed(row)):
                    stack.append((child, nxt))
        return out

    def starting(self, prefix: str) -> list[str]:
        """Stored words that go on after `prefix`."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return []
        out, stack = [], [child for c, child in node.items() if c != ""]
        while stack:
            at = stack.pop()
            for c, child in at.items():
                if c == "":
                    out.append(child)
                else:
                    stack.append(child)
        return out


@lru_cache(200_000)
def _closest(word: str) -> str | None:
    """Meaning of a word with typing errors, if one known word is closest."""
    table = _WORDS
    k = 1 if len(word) < 7 else 2
    if len(word) < 4:
        return None
    best = [(d, -len(w), table[w]) for d in range(1, k + 1) for w in _VOCABULARY.near(word, d) if w in table]
    swapped = {table[word[:i] + word[i + 1] + word[i] + word[i + 2 :]] for i in range(len(word) - 1) if word[:i] + word[i + 1] + word[i] + word[i + 2 :] in table}
    if swapped:
        return min(swapped)
    return min(best)[2] if best else None


_VOCABULARY = Trie([w for w in (*FIELD_OF, *KIND_OF, "grupo", "group", "growth", "fund", "consultores", "associados", "sociedade", "advogados", "company", "superior", "municipal", "unipessoal", "portugal", "crescimento", "higher") if len(w) >= 4])
_WORDS = {**{w: w for w in ("grupo", "growth", "consultores", "associados", "sociedade", "advogados", "company", "superior", "municipal", "unipessoal", "portugal", "crescimento", "higher")}, **FIELD_OF, **KIND_OF}


def parse(name: str) -> dict:
    """kind, fields (possible ones), number, stems and whether a stem is cut short ('cut').

    kind is '' where the name doesn't say; fields is empty where none is said.
    """
    text = PLACE.sub(" ", name.replace("\xa0", " "))
    partner = bool(re.search(r"&|\+|\s(?:e|and)\s|sociedade\s+de\s+advogados|\bassociados\b", fold(text)))
    text = SPLIT.sub(" ", text) if not text.isupper() else text
    flat = fold(text)
    flat = re.sub(r"\bs\.\s?a\.?(?=\W|$)", " sa ", flat)
    flat = re.sub(r"\bi\.\s?s\.\s?([a-z])\.?(?=\W|$)", r" is\1 ", flat)
    flat = re.sub(r"\ba\.\s?[a-z]\.\s?([a-z])\.(?=\W|$)", r" as\1 ", flat)
    flat = re.sub(r"\bc\.\s?m\.(?=\W|$)", " cm ", flat)
    tokens = re.findall(r"[a-z0-9]+\.?", flat)
    kind, number, legal, growth, stems, fields, cut, initials = "", 0, False, False, [], set(), "", set()
    for t in tokens:
        dotted, w = t.endswith("."), t.rstrip(".")
        if w in NUMBERS and not dotted and (growth or kind == "fund" or "fund" in tokens):
            number = NUMBERS[w]
        elif re.fullmatch(r"is[a-z]", w) and w[2] in INITIALS and not stems + [1] * (kind == "institute"):
            kind, fields = "institute", {INITIALS[w[2]]}
        elif re.fullmatch(r"as[a-z]", w) and w[2] in INITIALS and not dotted and not stems and not kind:
            kind, fields = "association", {INITIALS[w[2]]}
        elif w in LEGAL:
            legal = True
        elif w in ("growth",):
            growth = True
        elif w == "fund":
            kind = kind or ("fund" if not dotted else "foundation")
        elif w in NOISE or w in ("e", "and") and not dotted:
            continue
        elif w in KIND_OF and (len(w) > 1 or (dotted and not stems)) and not (kind and w in ("u", "uni", "ass", "cam")):
            kind = kind or KIND_OF[w]
        elif w in FIELD_OF:
            fields.add(FIELD_OF[w])
        elif len(w) == 1:
            if dotted:
                initials.add(w)
        elif dotted and len(w) <= 8 and (meant := {FIELD_OF[x] for x in FIELD_OF if x.startswith(w)} | ({"robotics"} if w == "robot" else set())):
            fields |= meant if len(meant) == 1 or not fields else set()
        elif dotted and (meant := {KIND_OF[x] for x in KIND_OF if x.startswith(w) and len(w) > 2}) and not kind:
            kind = min(meant)
        elif (near := _closest(w)) is not None:
            if near in FIELDS:
                fields.add(near)
            elif near in KINDS:
                kind = kind or near
            elif near == "growth":
                growth = True
            elif near in ("grupo", "company", "unipessoal", "portugal"):
                legal = True
        else:
            stems.append(w)
            if dotted:
                cut = w
    if growth:
        kind = "fund"
    if kind == "fund" and fields == set() and not growth and not number:
        kind = "foundation"
    if not kind and len(stems) >= 2 and partner:
        kind, fields = "partners", set()
    if not kind and (fields or legal or initials):
        kind = "company"
    if kind == "company" and not fields and initials:
        fields = {f for f in COMPANY if f[0] in initials or any(x[0] in initials for x in FIELDS[f].split())}
    if kind == "institute":
        fields -= {"health"} if len(fields) > 1 else set()
    if kind in ("university", "foundation", "municipality", "fund", "partners"):
        fields = set()
    return {"kind": kind, "fields": sorted(fields), "number": number, "stems": stems, "cut": cut}


#: Signature of names that say no field, by their words and by their words written together.
OPEN, JOINED = "open::0", "joined::0"


def signatures(p: dict) -> list[str]:
    """The signatures (kind:field:number) a parsed name may belong to; one for a full name."""
    kind, fields = p["kind"], p["fields"]
    if kind in ("company", "") and not fields and len(p["stems"]) > 1:
        return ["partners::0", OPEN]
    if kind in ("company", "") and not fields:
        return [f"company:{f}:0" for f in COMPANY] + (["partners::0"] if kind == "" else []) + [OPEN]
    if kind in ("institute", "association") and not fields:
        return [f"{kind}:{f}:0" for f in sorted(FIELDS)]
    if kind in ("company", "institute", "association"):
        return [f"{kind}:{f}:0" for f in fields]
    return [f"{kind}::{p['number']}"]


def walk(root: dict, word: str, k: int) -> set[str]:
    """Stored words within k errors, at most one of them an exchange of two neighbours.

    A Levenshtein automaton walks down the trie: its state holds, for each
    (letters of `word` read, exchange used), the least errors; a branch dies
    with an empty state. Half an exchange waits for the other letter.
    """
    n, out = len(word), set()

    def closed(row: dict[int, int]) -> dict[int, int]:
        """With letters of `word` left out. States are 2 * letters + exchange used."""
        for s in range(2 * n):
            e = row.get(s, k)
            if e < k and row.get(s + 2, k + 1) > e + 1:
                row[s + 2] = e + 1
        return row

    stack = [(root, closed({0: 0}), ())]
    while stack:
        node, state, half = stack.pop()
        for c, child in node.items():
            if c == "":
                if 2 * n in state or 2 * n + 1 in state:
                    out.add(child)
                continue
            row: dict[int, int] = {}
            waiting = []
            for s, e in state.items():
                i = s >> 1
                if e < k and row.get(s, k + 1) > e + 1:
                    row[s] = e + 1
                if i < n:
                    d = e + (word[i] != c)
                    if d <= k and row.get(s + 2, k + 1) > d:
                        row[s + 2] = d
                    if e < k and not s & 1 and i + 1 < n and word[i + 1] == c != word[i]:
                        waiting.append((i, e + 1))
            for i, e in half:
                if word[i] == c and row.get(2 * i + 5, k + 1) > e:
                    row[2 * i + 5] = e
            if row or waiting:
                stack.append((child, closed(row), tuple(waiting)))
    return out


def neighbours(stem: str, trie: Trie, cut: bool = False) -> list[str]:
    """Stored stems that `stem` may be a misspelling of; for a stem cut short also those it begins."""
    out = walk(trie.root, stem, bound(len(stem)))
    if cut:
        out |= set(trie.starting(stem))
    return sorted(out)


#: Probes of one trie that are answered in one task; more are spread over several.
SHARD = 4_000
#: Letters of the beginning and of the end by which stems are shared out.
ENDS = 4
#: Two stems in so many spellings each and of so many persons each, none in common, are two organisations.
FREQUENT, KNOWN_BY = 4.0, 5
#: A word of open names that stands with so many different other words says little about who is meant.
WEAK = 5
PARSED = "id string, name string, kind string, sigs array<string>, stems array<string>, joined string, cut string, weight double"


def tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has by default; few bytes can be much work here, so they aren't coalesced."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parsed_names(orgs: DataFrame) -> DataFrame:
    """PARSED rows of the distinct (id, name) that are no placeholders; names without a proper word are left out."""
    people = F.coalesce(F.size(F.from_json("people", "array<string>")), F.lit(0))
    rows = (
        orgs.where("id IS NOT NULL AND name IS NOT NULL AND coalesce(placeholder, 0) <> 1")
        .groupBy("id", "name")
        .agg(F.max(people).alias("n"))
        .join(orgs.where("placeholder = 1").select("id").distinct(), "id", "left_anti")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, name, n in zip(*(c.to_pylist() for c in b.columns)):
                p = parse(name)
                if p["stems"]:
                    out.append({"id": i, "name": name, "kind": p["kind"], "sigs": signatures(p), "stems": sorted(set(p["stems"])), "joined": "".join(p["stems"]), "cut": p["cut"], "weight": 1 + max(n, 0) / 100})
            schema = pa.schema([("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("sigs", pa.list_(pa.string())), ("stems", pa.list_(pa.string())), ("joined", pa.string()), ("cut", pa.string()), ("weight", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("id", "name", "n").repartition(tasks(orgs), "id").mapInArrow(run, PARSED)


def _shards(stored: bool) -> Column:
    """Keys of the tries a stem lies in, or may have its neighbours in.

    Of two errors one lies outside the last ENDS letters unless these are
    unhurt: either the end is the same, or the beginning has one error at most,
    and then the two beginnings are the same after leaving out one letter.
    Shorter stems have one error, and are the same after leaving out one letter.
    """
    n, p = "length(stem)", ENDS
    less = lambda text, size: f"transform(sequence(1, {size}), i -> concat(substring({text}, 1, i - 1), substring({text}, i + 1, 999999)))"
    front, more = f"substring(stem, 1, {p})", f"substring(stem, 1, {p + 1})"
    long = f"array(concat('z', right(stem, {p})), concat('p', {front}))", f"transform({less(front, p)}, x -> concat('p', x))", f"transform({less(more, p + 1)}, x -> concat('p', x))"
    short = f"transform(array_append({less('stem', n)}, stem), x -> concat('d', x))"
    if stored:  # the bound belongs to the probe, which may be two letters longer or shorter
        made = f"concat(array(concat('c', substring(stem, 1, 3))), IF({n} >= {LONG - 2}, concat({long[0]}, {long[1]}), array()), IF({n} BETWEEN {SHORT - 1} AND {LONG}, {short}, array()))"
    else:
        made = f"concat(IF(cut AND {n} >= 3, array(concat('c', substring(stem, 1, 3))), array()), CASE WHEN {n} >= {LONG} THEN concat({', '.join(long)}) WHEN {n} >= {SHORT} THEN {short} ELSE array() END)"
    return F.explode(F.expr(f"array_distinct({made})"))


def trie_join(stems: DataFrame, probes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(stem, cut, near), distinct: all pairs of a probe and a stored stem within the bounds.

    `stems` is (stem), `probes` (stem, cut). Stems are shared out to tries by
    their beginnings and ends, so a probe goes only where its neighbours can
    be; each trie is built once, from rows that arrive sorted. A trie with more
    than `shard` probes is copied to several tasks.
    """
    left = stems.select("stem").distinct().select(_shards(True).alias("key"), F.lit(0).alias("side"), "stem", F.lit(False).alias("cut"))
    right = probes.select("stem", "cut").distinct().select("stem", "cut", _shards(False).alias("key")).select("key", F.lit(1).alias("side"), "stem", "cut")
    hot = right.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    left = left.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "side", "stem", "cut")
    right = right.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("stem"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "side", "stem", "cut")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, Trie()
        for b in batches:
            out = []
            for key, part, side, stem, cut in zip(*(c.to_pylist() for c in b.columns)):
                if (key, part) != at:
                    at, trie = (key, part), Trie(both=False)
                if side == 0:
                    trie.add(stem)
                elif trie.root:
                    out += [(stem, cut, w) for w in (trie.starting(stem) if key[0] == "c" else walk(trie.root, stem, bound(len(stem))))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], ["stem", "cut", "near"])

    rows = left.unionByName(right).repartition(tasks(stems), "key", "part").sortWithinPartitions("key", "part", "side")
    return rows.mapInArrow(search, "stem string, cut boolean, near string").distinct()


def distinct_houses(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(sig, stem, near) of pairs of frequent stems whose persons have nothing in common.

    `pairs` is (sig, stem, near), `held` (sig, stem, person).
    """
    of = lambda side: held.select("sig", F.col("stem").alias(side), "person")
    size = held.groupBy("sig", "stem").agg(F.count_distinct("person").alias("n")).where(F.col("n") >= KNOWN_BY)
    known = pairs.join(size.select("sig", "stem"), ["sig", "stem"]).join(size.select("sig", F.col("stem").alias("near")), ["sig", "near"])
    common = known.join(of("stem"), ["sig", "stem"]).join(of("near"), ["sig", "near", "person"]).select("sig", "stem", "near").distinct()
    return known.select("sig", "stem", "near").join(common, ["sig", "stem", "near"], "left_anti")


def representatives(stems: DataFrame, probes: DataFrame, held: DataFrame) -> DataFrame:
    """(sig, stem, cut, rep): the weightiest stem within the bounds, and from there on uphill to the top.

    Weight is the number of distinct spellings with the stem; the persons on
    them are a part below 1, so they decide between as many spellings only.
    Every stem is searched. Two frequent stems with separate persons stay apart.
    A stem cut without a sign of it (no stored stem is near) stands for the only
    one that goes on after it by at most half its length.
    """
    stored = stems.select("stem").distinct()
    found = as_table(trie_join(stored, probes.select("stem", F.lit(True).alias("cut")).distinct().unionByName(probes.select("stem", F.lit(False).alias("cut")).distinct()).distinct()), "name-pairs")
    exact = probes.join(stems, ["sig", "stem"]).where("NOT cut").select("sig", "stem", "cut", F.col("stem").alias("near"), "w")
    weight = stems.select("sig", F.col("stem").alias("near"), "w")
    met = probes.join(found, ["stem", "cut"]).join(weight, ["sig", "near"]).select("sig", "stem", "cut", "near", "w").unionByName(exact).distinct()
    own = stems.select("sig", "stem", F.col("w").alias("own"))
    met = as_table(met.join(own, ["sig", "stem"], "left"), "name-neighbours")
    apart = distinct_houses(met.where((F.col("stem") != F.col("near")) & (F.col("w") >= FREQUENT) & (F.col("own") >= FREQUENT)).select("sig", "stem", "near").distinct(), held)
    best = met.join(apart, ["sig", "stem", "near"], "left_anti").groupBy("sig", "stem", "cut").agg(F.max(F.struct("w", "near")).alias("b")).select("sig", "stem", "cut", F.col("b.near").alias("rep"))
    # not cut by a dot, and without a neighbour but itself: the one stem it begins
    begun = (
        found.where("cut").where((F.length("stem") >= 6) & F.col("near").startswith(F.col("stem")) & (F.length("near") > F.length("stem")) & (F.length("near") <= 1.5 * F.length("stem")))
        .join(probes.where("NOT cut").select("sig", "stem"), "stem").join(weight, ["sig", "near"])
        .groupBy("sig", "stem").agg(F.min("near").alias("near"), F.max("near").alias("_z")).where("near = _z").select("sig", "stem", F.col("near").alias("_begun"))
    )
    roots = uphill(as_table(best, "name-reps"))
    begun = begun.join(roots.where("NOT cut").select("sig", F.col("stem").alias("_begun"), F.col("rep").alias("_root")), ["sig", "_begun"])
    lone = begun.join(roots.where("NOT cut").select("sig", "stem", "rep"), ["sig", "stem"], "left").where("rep IS NULL OR rep = stem").select("sig", "stem", "rep", "_root")
    lone = as_table(lone, "name-begun")
    unmet = lone.where("rep IS NULL").select("sig", "stem", F.lit(False).alias("cut"), F.col("_root").alias("rep"))
    return together(roots.unionByName(unmet), lone.where("rep IS NOT NULL AND rep <> _root").select("sig", F.col("rep").alias("a"), F.col("_root").alias("b")))


def uphill(best: DataFrame) -> DataFrame:
    """Follow rep to its own rep until nothing changes; each step doubles the way, and it ends as weights only grow."""
    while True:
        own = best.where("NOT cut AND stem <> rep").select("sig", F.col("stem").alias("rep"), F.col("rep").alias("_next"))
        moved = best.join(own, ["sig", "rep"], "left")
        if moved.where("_next IS NOT NULL").isEmpty():
            return best
        best = as_table(moved.select("sig", "stem", "cut", F.coalesce("_next", "rep").alias("rep")), "name-reps")


def together(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """reps with the greatest rep of each component of `edges` (sig, a, b) in place of its own."""
    both = as_table(edges.unionByName(edges.select("sig", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "name-edges")
    labels = both.select("sig", "a").distinct().withColumn("label", F.col("a"))
    while True:
        best = both.join(labels.select("sig", F.col("a").alias("b"), F.col("label").alias("_l")), ["sig", "b"]).groupBy("sig", "a").agg(F.max("_l").alias("_l"))
        moved = as_table(labels.join(best, ["sig", "a"]).select("sig", "a", F.greatest("label", "_l").alias("label"), (F.col("_l") > F.col("label")).alias("moved")), "name-labels")
        labels = moved.select("sig", "a", "label")
        if moved.where("moved").isEmpty():
            return as_table(reps.join(labels.select("sig", F.col("a").alias("rep"), "label"), ["sig", "rep"], "left").select("sig", "stem", "cut", F.coalesce("label", "rep").alias("rep")).distinct(), "name-reps")


def open_entities(each: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, name, entity) of names that belong to no known signature, by all their words.

    Words that stand with many different others are weak; names with the same
    strong words are one organisation if at most one set of weak words occurs
    with them, else by strong and weak words. Order doesn't count, and words
    written together count as the words apart.
    """
    words = each.where(F.col("sig") == OPEN).join(reps.where(F.col("sig") == OPEN).withColumnRenamed("cut", "is_cut"), ["sig", "stem", "is_cut"], "left").select("id", "name", F.coalesce("rep", "stem").alias("word"))
    sets = words.groupBy("id", "name").agg(F.sort_array(F.collect_set("word")).alias("words"))
    weak = sets.where("size(words) > 1").select("words", F.explode("words").alias("word")).groupBy("word").agg(F.count_distinct("words").alias("n")).where(F.col("n") >= WEAK).select("word", F.lit(True).alias("weak"))
    marked = sets.select("id", "name", F.explode("words").alias("word")).join(weak, "word", "left")
    keyed = marked.groupBy("id", "name").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("weak").isNull(), F.col("word")))), "|").alias("s"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("weak"), F.col("word")))), "|").alias("v"))
    kinds = keyed.where("v <> ''").groupBy("s").agg(F.count_distinct("v").alias("k"), F.min("v").alias("_v"))
    keyed = keyed.join(kinds, "s", "left").select("id", "name", F.concat_ws("|", F.lit(OPEN), "s", F.when((F.col("v") == "") & (F.col("k") == 1) & (F.col("s") != ""), F.col("_v")).otherwise(F.col("v"))).alias("label"))
    joined = each.where(F.col("sig") == JOINED).join(reps.where(F.col("sig") == JOINED).withColumnRenamed("cut", "is_cut"), ["sig", "stem", "is_cut"], "left").select("id", "name", F.coalesce("rep", "stem").alias("joined"))
    labels = as_table(keyed.join(joined, ["id", "name"]), "open-names")
    while True:  # the least label of all names written together alike, and back, until nothing changes
        over = labels.groupBy("joined").agg(F.min("label").alias("_l"))
        step = labels.join(over, "joined").groupBy("label").agg(F.min("_l").alias("_l"))
        moved = labels.join(step, "label")
        if moved.where("_l < label").isEmpty():
            return labels.select("id", "name", F.col("label").alias("entity"))
        labels = as_table(moved.select("id", "name", "joined", F.col("_l").alias("label")), "open-names")


def entities(orgs: DataFrame) -> DataFrame:
    """(id, entity): spellings with the organisation they denote, as a key of signature and representative stems.

    A name that doesn't say its field or second partner is given to the one
    organisation it can mean; if there are several, to the one whose persons it
    shares most; else it stays by itself. Names that fit no organisation of a
    known kind are matched among themselves, see open_entities().
    """
    names = as_table(parsed_names(orgs), "names")
    flat = names.select("id", "name", "kind", F.explode("sigs").alias("sig"), "stems", "cut", "weight", (F.size("sigs") == 1).alias("full"))
    each = flat.select("*", F.explode("stems").alias("stem")).withColumn("is_cut", F.col("stem") == F.col("cut"))
    together = names.where(F.array_contains("sigs", OPEN)).select("id", "name", "kind", F.lit(JOINED).alias("sig"), "stems", "cut", "weight", F.lit(False).alias("full"), F.col("joined").alias("stem"), F.lit(False).alias("is_cut"))
    each = as_table(each.unionByName(together), "name-stems")
    persons_ = F.sum(F.col("weight") - 1)
    own = F.col("full") | F.col("sig").isin(OPEN, JOINED)
    stems = each.where(own).groupBy("sig", "stem").agg((F.count_distinct("name") + persons_ / (1 + persons_)).alias("w"))
    probes = each.select("sig", "stem", F.col("is_cut").alias("cut")).unionByName(stems.select("sig", "stem", F.lit(False).alias("cut"))).distinct()
    persons = orgs.where("id IS NOT NULL").select("id", F.explode(F.from_json("people", "array<string>")).alias("person")).distinct()
    held = each.where("full").select("id", "sig", "stem").join(persons, "id").select("sig", "stem", "person")
    reps = representatives(stems, probes, held)
    resolved = each.where(~F.col("sig").isin(OPEN, JOINED)).join(reps.withColumnRenamed("cut", "is_cut"), ["sig", "stem", "is_cut"], "left")
    keys = resolved.groupBy("id", "name", "sig", "full", "kind").agg(F.sort_array(F.collect_set("rep")).alias("reps"), F.bool_and(F.col("rep").isNotNull()).alias("ok")).where("ok")
    whole = F.concat_ws("|", F.concat(F.lit(""), "sig"), F.concat_ws("|", "reps"))
    lone = (F.col("sig") == "partners::0") & (F.col("kind") != "partners")
    sure = keys.where(~lone).select("id", "name", "full", whole.alias("entity"))
    houses = as_table(keys.where("sig = 'partners::0' AND kind = 'partners'").select(whole.alias("entity"), F.explode("reps").alias("rep")).distinct(), "houses")
    partner = keys.where(lone & (F.size("reps") == 1)).select("id", "name", "full", F.col("reps")[0].alias("rep")).join(houses, "rep").select("id", "name", "full", "entity")
    both = keys.where(lone & (F.size("reps") > 1)).select("id", "name", "full", whole.alias("entity")).join(houses.select("entity").distinct(), "entity").select("id", "name", "full", "entity")
    options = as_table(sure.unionByName(partner).unionByName(both).distinct(), "name-options")
    n = options.groupBy("id", "name").agg(F.count("*").alias("n"))
    single = options.join(n.where("n = 1"), ["id", "name"]).select("id", "entity")
    # several: the organisation with most persons in common, if one is ahead
    open_ = options.join(n.where("n > 1"), ["id", "name"]).select("id", "name", "entity")
    of_entity = options.where("full").select("id", "entity").join(persons, "id").select("entity", "person").distinct()
    common = open_.join(persons, "id").join(of_entity, ["entity", "person"]).groupBy("id", "name", "entity").agg(F.count("*").alias("n"))
    most = common.groupBy("id", "name").agg(F.max(F.struct("n", "entity")).alias("m"), F.max("n").alias("top"))
    ahead = common.join(most, ["id", "name"]).where("n = top").groupBy("id", "name").agg(F.count("*").alias("k"), F.max("entity").alias("entity")).where("k = 1")
    # none: among themselves
    free = open_entities(each.join(n.select("id", "name"), ["id", "name"], "left_anti"), reps).select("id", "entity")
    return single.unionByName(ahead.select("id", "entity")).unionByName(free).distinct()


def variants(orgs: DataFrame) -> DataFrame:
    """(org_a, org_b), org_a < org_b: two ids whose spellings denote the same organisation.

    Null ids and names, placeholders and names without a proper word are in no
    pair; repeated rows count once; extra columns are ignored; an empty table
    gives no rows.
    """
    e = entities(orgs)
    a, b = e.select("entity", F.col("id").alias("org_a")), e.select("entity", F.col("id").alias("org_b"))
    return a.join(b, "entity").where("org_a < org_b").select("org_a", "org_b").distinct()
