"""Tries and automata against brute force, readings of names, and variants of a small register."""

import random

import pytest

from tidemark.llm import names as N


def lev(a, b):
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y)))
        one = row
    return one[-1]


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_near_is_the_edit_distance(letters):
    random.seed(4)
    word = lambda: "".join(random.choice(letters) for _ in range(random.randint(1, 9)))
    for _ in range(80):
        words = {word() for _ in range(40)}
        t = N.Trie(sorted(words))
        for k in range(4):
            q = word()
            assert t.near(q, k) == {w for w in words if lev(w, q) <= k}
    assert N.Trie().near("a", 1) == set() and N.Trie(["a"]).near("", 1) == set()


def test_exchange_counts_once_and_cut_stems_continue():
    t = N.Trie(["gospunzedin", "mascilotir"])
    assert N.neighbours("gosupnzedni", t) == []  # two exchanges of which one is one error too many with k - 1
    assert N.neighbours("gosupnzedin", t) == ["gospunzedin"]
    assert N.neighbours("gospunze", t, cut=True) == ["gospunzedin"]


@pytest.mark.parametrize(
    "name,kind,fields,number,stems",
    [
        ("Gurcongonir Labs, Lda.", "company", ["labs"], 0, ["gurcongonir"]),
        ("  GURCONGONIR   LBAS ", "company", ["labs"], 0, ["gurcongonir"]),
        ("RanzarnirleLabs", "company", ["labs"], 0, ["ranzarnirle"]),
        ("Seguros Dascoguler", "company", ["insurance"], 0, ["dascoguler"]),
        ("Universidade de Tuzasnerni - Polo de Sofepissu", "university", [], 0, ["tuzasnerni"]),
        ("U. Tuzasnerni", "university", [], 0, ["tuzasnerni"]),
        ("I.S.R. de Laritaton", "institute", ["robotics"], 0, ["laritaton"]),
        ("Laritaton Higher Institute of Robotics", "institute", ["robotics"], 0, ["laritaton"]),
        ("Zirfozesnur Growth Fund II, SCR", "fund", [], 2, ["zirfozesnur"]),
        ("Fundo de Crescimento Zirfozesnur I", "fund", [], 1, ["zirfozesnur"]),
        ("The Merzannorfa Foundation", "foundation", [], 0, ["merzannorfa"]),
        ("A.L.D. Lonfenzagis", "association", ["data"], 0, ["lonfenzagis"]),
        ("Foncurfofir + Canganpanmu Consultores", "partners", [], 0, ["foncurfofir", "canganpanmu"]),
        ("", "", [], 0, []),
        ("—", "", [], 0, []),
    ],
)
def test_parse(name, kind, fields, number, stems):
    p = N.parse(name)
    assert (p["kind"], p["fields"], p["number"], p["stems"]) == (kind, fields, number, stems)


ORGS = [
    ("a1", "Gospunzedin Logistics", '["p1", "p2"]', 0), ("a2", "Gospunze. Logistics", None, None), ("a3", "Grupo Gospunzedin Logistics", "[]", 0), ("a4", "GOSPUNZEDIN LOGISTISC", "[]", 0),
    ("b1", "Gospunzedin Foods", "[]", 0), ("c1", "Tenenperter & Lucussidir", "[]", 0), ("c2", "Lucussidir e Tenenperter", "[]", 0), ("c3", "Tenenperter, Lucusidir & Associados", "[]", 0),
    ("d1", "Dejurzespar Growth Fund I", "[]", 0), ("d2", "Dejurzespar Growth Fund II", "[]", 0), ("e1", "Micusfilor University", "[]", 0), ("e2", "Univ. Micusfilor", "[]", 0),
    ("x", "Independent", "[]", 1), ("x2", "Independent", "[]", 1), (None, "Gospunzedin Logistics", "[]", 0), ("z", None, "[]", 0), ("a1", "Gospunzedin Logistics", '["p1", "p2"]', 0),
    ("f1", "Podusdurso Health", "[]", 0), ("f2", "Podusdurso", "[]", 0), ("g1", "Basfaszibas Finance", '["q1"]', 0), ("g2", "Basfaszibas Studio", '["q2"]', 0), ("g3", "Basfaszibas Lda", '["q2"]', 0),
]
SCHEMA = "id string, name string, people string, placeholder int"
WANT = {("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3"), ("e1", "e2"), ("f1", "f2"), ("g2", "g3")}


@pytest.mark.parametrize("shard", [4000, 2])
def test_variants(spark, monkeypatch, shard):
    """Also with tries of two stems; clashing extra columns, nulls, repeats and placeholders do no harm."""
    monkeypatch.setattr(N.trie_join, "__defaults__", (shard,))
    df = spark.createDataFrame([(*o, "s", 1) for o in ORGS], SCHEMA + ", sig string, w int")
    assert {tuple(r) for r in N.variants(df).collect()} == WANT
    assert N.variants(df.limit(0)).count() == 0


def test_a_misspelling_with_many_persons_is_still_linked(spark):
    """Persons don't make a stem established: 400 of them, or 4 ids of one spelling, stand for one spelling."""
    many = "[" + ", ".join(f'"p{i}"' for i in range(400)) + "]"
    right = ["Gospunzedin Logistics", "Gospunzedin Logistics, Lda.", "GOSPUNZEDIN LOGISTICS", "Grupo Gospunzedin Logistics", "Gospunzedin  Logistics"]
    rows = [(f"r{k}", x, "[]", 0) for k, x in enumerate(right)] + [("m0", "Gospunzedni Logistics", many, 0)] + [(f"m{k}", "Gospunzdin Logistics", "[]", 0) for k in range(1, 5)]
    ids = sorted(r[0] for r in rows)
    assert {tuple(r) for r in N.variants(spark.createDataFrame(rows, SCHEMA)).collect()} == {(a, b) for a in ids for b in ids if a < b}


def test_frequent_variants_are_linked(spark):
    """Two stems in many spellings each are one organisation, unless they have separate persons."""
    forms = ["{} Labs", "{} Labs, Lda.", "{} LABS", "Grupo {} Labs", "{} Labs (Porto)"]
    rows = [(f"{s}{k}", f.format(x), "[]", 0) for s, x in (("a", "Mascilotir"), ("b", "Mascilotar")) for k, f in enumerate(forms)]
    ids = sorted(r[0] for r in rows)
    pairs = {(a, b) for a in ids for b in ids if a < b}
    assert {tuple(r) for r in N.variants(spark.createDataFrame(rows, SCHEMA)).collect()} == pairs
    held = [(i, n, str([f"{i[0]}{j}" for j in range(6)]).replace("'", '"'), z) for i, n, _, z in rows]
    assert {tuple(r) for r in N.variants(spark.createDataFrame(held, SCHEMA)).collect()} == {p for p in pairs if p[0][0] == p[1][0]}


def test_names_without_a_known_word(spark):
    names = {"a1": "Mistral", "a2": "Mistrall", "b1": "Feedzai", "b2": "Feedzay, Lda", "c1": "Unbabel, Lda", "c2": "Unbabel Portugal", "d1": "Open AI", "d2": "OpenAI", "e1": "Kaya Kran", "e2": "Kran Kaya", "f": "Sword", "g": "Talkdesk"}
    names |= {f"h{i}": f"{x} Werke" for i, x in enumerate(["Alfana", "Borimo", "Cestula", "Dorrema", "Fagotti", "Gumbera"])} | {"h9": "Alfana"}
    rows = [(i, n, "[]", 0) for i, n in names.items()]
    got = {tuple(r) for r in N.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("d1", "d2"), ("e1", "e2"), ("h0", "h9")}


def test_sharded_tries_find_every_neighbour(spark):
    """The trie join against one trie of everything, exchanges and beginnings included."""
    random.seed(5)
    syl = ["ba", "con", "dir", "e", "fos", "gu", "li", "mar", "to", "z"]
    stems = sorted({"".join(random.choice(syl) for _ in range(random.randint(2, 5))) for _ in range(300)})

    def damaged(w):
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(w))
            w = random.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        return w

    asked = sorted({(damaged(random.choice(stems)), random.random() < 0.2) for _ in range(500)})
    asked = [(w, c) for w, c in asked if w]
    trie = N.Trie(stems)
    want = {(w, c, n) for w, c in asked for n in N.neighbours(w, trie, c and len(w) >= 3) if N.bound(len(w)) or n != w}
    for shard in (4000, 3):
        got = N.trie_join(spark.createDataFrame([(x,) for x in stems], "stem string"), spark.createDataFrame(asked, "stem string, cut boolean"), shard).collect()
        assert {tuple(r) for r in got if N.bound(len(r.stem)) or r.near != r.stem} == want
