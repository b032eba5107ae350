"""Tokenizer, leakage, canonical values, main body, spam and trees."""

import random
from array import array

import numpy as np
import pytest

from tidemark.llm import boilerplate as B
from tidemark.llm import canonical as C
from tidemark.llm import leakage as L
from tidemark.llm import queries
from tidemark.llm import spam as S
from tidemark.llm import tokenize as T
from tidemark.llm import trees

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(f.read())


ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "it's WE'LL 12²½", "﻿x​ y\xa0z", "naïve café 漢字🙂🙂", "x" * 5000, "ab" * 300 + " " * 50 + "!" * 400, "<|endoftext|> a", "\t\ta\r\nb\x0b", "\x85a b", "a\x1cb"]


def test_same_as_the_public_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    random.seed(3)
    texts = ODD + ["".join(random.choice(" \n\tabcé1.,'’—漢") for _ in range(random.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        out = array("i")
        encoder.encode(t, out)
        assert list(out) == own.encode_ordinary(t), repr(t[:80])
        raw = b"".join({v: k for k, v in encoder.ranks.items()}[i] for i in out) if len(t) < 30 and t in ODD else None
        assert raw is None or raw.decode() == t


def test_short_and_long_pieces_merge_alike(encoder):
    random.seed(9)
    for _ in range(300):
        w = bytes(random.choice(b"abcdefghij -\xc3\xa9") for _ in range(random.randint(2, 300)))
        assert encoder._scan(w) == encoder._heap(w)


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "Olá mundo", "x"), (2, "", "x"), (3, None, "x"), (1, "Olá mundo", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in T.encode_corpus(df).collect()), key=str)
    assert [g for g in got if g[0] in (2, 3)] == [(2, ()), (3, ())] and len(got) == 5
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    random.seed(6)
    words = [f"Wörd{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(words, k=random.randint(5, 30)))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(k, " – ".join([" ".join(random.choices(words, k=9)), " ".join(items[k % 12][1].upper().split()[k % 7 :][: 6 + k]), "tail²"])) for k in range(60)] + [(90, None), (91, ""), (92, items[3][1]), (92, items[3][1])]
    want = set()
    for d, t in docs:
        w = L.normal_words(t or "")
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, x in items:
            v = L.normal_words(x or "")
            if any(tuple(v[j : j + 12]) in grams for j in range(len(v) - 11)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = L.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and want
    parts = L.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), max_chars=300).collect()  # several automata
    assert sorted(map(str, parts)) == sorted(map(str, found))
    text = {d: t for d, t in docs if t}
    for r in found:
        assert len(L.normal_words(text[r.doc_id][r.start : r.end])) == r.words >= 12
    assert L.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_spans_of_decomposed_letters():
    t = "Á½ ét ﬁn"
    assert [t[a:b] for a, b in L.word_spans(t)] == ["Á½", "½", "ét", "ﬁn"] or len(L.word_spans(t)) == len(L.normal_words(t))


ENTRIES = [("people.role", "chief-data", "Chief Data Officer", "Diretor de dados", "CDO"), ("people.role", "founder", "Founder", "Fundador", None), ("people.role", "head-of-growth", "Head of Growth", "Responsável de crescimento", None)]


def test_pigeonhole_finds_all_within_bounds(spark):
    """The join against levenshtein of everything with everything."""
    random.seed(8)
    wordings = C.reference(ENTRIES)

    def damaged(p):
        for _ in range(random.randint(0, 5)):
            i = random.randrange(len(p) + 1)
            p = random.choice([p[:i] + random.choice("abcxyz") + p[i:], p[:i] + p[i + 1 :], p[:i] + random.choice("xyz") + p[i + 1 :]])
        return p

    lev = __import__("test_names").lev
    values = sorted({v for v in (" ".join(damaged(random.choice(wordings)[2]).split()) for _ in range(400)) if C.plain(v) == v and " na " not in v and " at " not in v and " no " not in v})
    got = {r.value: r.entry for r in C.map_values(spark.createDataFrame([("people.role", v) for v in values], "field string, value string"), ENTRIES).collect()}
    for v in values:
        near = [(lev(v, p), e) for _, e, p in wordings if lev(v, p) <= C.allowed(len(p))]
        assert got[v] == (min(near)[1] if near else "none"), v


def test_lists_over_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ENTRIES", 5)
    roles = spark.createDataFrame([(f"e{i}", "role", f"Entry {i}", None, None, None) for i in range(8)], "entry string, kind string, label string, pt string, short string, role_class string")
    empty = spark.createDataFrame([], "id string, type string, label string, pt string, pattern string")
    with pytest.raises(ValueError):
        C.entries_of(roles, empty)
    assert len(C.entries_of(roles.limit(5), empty)) == 5


def test_wordings_are_learned_from_records(spark):
    """No list says 'coder' or 'numbers person'; the persons who hold them, and tagged words, do."""
    people = [(f"p{i}", r) for i in range(12) for r in (["Chief Data Officer", "Numbers person"] if i < 6 else ["Founder", "Made it up"] if i < 9 else ["Founder" if i % 2 else "CDO", "Cook"])]
    people += [(f"q{i}", r) for i in range(40) for r in (["Founder", "Guest"] if i % 4 else ["CDO", "Guest"])]
    tags = [("p1", "energy", "watts"), ("p2", "energy", "Watts"), ("p3", "energy", "watts"), ("p4", None, "Watts!"), ("p5", None, "old maps"), ("p6", None, "energi")]
    got = C.canonical_entries(
        spark.createDataFrame(people, "id string, role string"),
        spark.createDataFrame([], "id string, role_class string"),
        spark.createDataFrame(tags, "person string, tag string, matched string"),
        spark.createDataFrame([("chief-data", "role", "Chief Data Officer", "Diretor de dados", "CDO", "x"), ("founder", "role", "Founder", "Fundador", None, "x")], "entry string, kind string, label string, pt string, short string, role_class string"),
        spark.createDataFrame([("energy", "s", "Energy", "Energia", r"\benerg(y|ia)\b"), ("tourism", "s", "Tourism", "Turismo", None)], "id string, type string, label string, pt string, pattern string"),
    )
    of = {(r.field, r.value): r.entry for r in got.collect()}
    assert of["people.role", "Numbers person"] == "chief-data" and of["people.role", "Cook"] == of["people.role", "Guest"] == "none" and of["people.role", "Made it up"] in ("founder", "none")
    assert of["person_tags.matched", "Watts!"] == "energy" and of["person_tags.matched", "old maps"] == "none" and of["person_tags.matched", "energi"] == "energy"


def test_forms_and_unmatched(spark):
    values = {"C.D.O. @ Some House": "chief-data", "FUNDADORA – X": "founder", "Growth, Head": "head-of-growth", "Head, Growth, Some House": "head-of-growth", "Fonder": "founder", "diretora\xa0de  dados;": "chief-data", "Founder's dog walker": "none", "Head of Gardening": "none", "—": "none", "CDO – Independent": "chief-data"}
    df = spark.createDataFrame([("people.role", v) for v in values], "field string, value string")
    assert {r.value: r.entry for r in C.map_values(df, ENTRIES).collect()} == values
    assert C.map_values(df.limit(0), ENTRIES).count() == 0
    assert {r.entry for r in C.map_values(df, []).collect()} == {"none"}


def test_all_free_values_are_listed(spark):
    from tidemark.tables import table

    rows = queries.QUERIES["p7_found"](spark, SMALL)
    free = C.free_values(*(table(spark, SMALL, t) for t in ("people", "nodes", "person_tags")))
    assert rows.count() == rows.distinct().count() == free.count() == rows.join(free, ["field", "rec", "value"]).count()


PAGE = """We value your privacy. You may accept, reject or manage your choices at any time.
Reject

Home › Podcasts › Search › Menu
A portal calls the harbour a pioneer in robotics
Por Ana Silva
Share
The consortium plans 168 grants by the end of next year, and the town awaits an answer from the council.
All rights reserved is not a licence, the court reminded the parties in its ruling.
Nothing followed.
- The report compares open data across ten towns
Advertisement
Read also: Something else entirely here
«The call opened in April and drew many more applications than the year before that.»
Most read

Researchers measured the power draw of a reading tutor
The jury singled out a house for its work on justice
Comments
Ana Silva: Great talk.
Privacy policy
© 2026 Some House. All rights reserved."""


def pages(spark, n=60):
    return spark.createDataFrame([(f"s{i}", PAGE.replace("168", str(i)).replace("harbour", f"harbour{i}"), "Some House") for i in range(n)] + [("none", None, None), ("empty", "", "x"), ("error", "Page not found", None), ("nav", "Home\nMenu\nSearch", None), ("s0", PAGE.replace("168", "0").replace("harbour", "harbour0"), "Some House")], "id string, frozen string, publisher string")


def test_main_body(spark):
    got = {}
    for r in B.main_body(pages(spark)).collect():
        got.setdefault(r.id, []).append(r.line_no)
    assert {tuple(sorted(v)) for v in got.values()} == {(4, 7, 8, 9, 10, 13)} and set(got) == {f"s{i}" for i in range(60)}
    assert B.main_body(pages(spark).limit(0)).count() == 0


def test_decoding_keeps_to_the_tree():
    x = np.zeros((6, len(B.NAMES)))
    assert not B.decode(np.array([0.5, -3, -3, -3, -3, -3.0]), x).any()  # too weak to open zone and page
    assert B.decode(np.array([3.0, -0.2, 3, -4, -4, 3]), x).tolist() == [True, True, True, False, False, True]
    x[3, B.NAMES.index("share")] = 1  # a common line that no paragraph follows begins a zone
    assert B.decode(np.array([3.0, 3, 3, -4, 0.6, -4]), x).tolist() == [True] * 3 + [False] * 3


def site(i, words, comment="Great."):
    """A page of a site with its own wording of furniture, and which of its lines are body."""
    random.seed(i)
    furniture, body = (lambda *x: [(y, False) for y in x]), (lambda *x: [(y, True) for y in x])
    lines = furniture(*words[:4]) + body(f"A portal calls harbour {i} a pioneer in robotics") + furniture(f"{words[4]} · {i % 28} May 2026")
    for _ in range(random.randint(2, 5)):
        lines += body(told(1)) + (furniture(words[5]) if random.random() < 0.4 else [])
    lines += furniture(words[6], *[" ".join(told(1).split()[:9]) for _ in range(3)], words[7], f"Ana Silva: {comment}", f"© 2026 {words[8]}. {words[9]}.")
    return "\n".join(x for x, _ in lines), {k for k, (_, b) in enumerate(lines) if b}


def test_furniture_of_unseen_wording(spark):
    """Sites whose wordings stand in no list are read by what the trees learned on others."""
    seen = ["Home", "Search", "Menu", "Podcasts", "By Ana Silva", "Advertisement", "Most read", "Comments", "Some House", "All rights reserved"]
    other = ["Velkomin", "Leita", "Yfirlit", "Hlaðvarp", "Skrifað af Ana Silva", "Kostað efni", "Mest sótt", "Raddir lesenda", "Blað Eitt", "Allur réttur áskilinn"]
    made = {f"a{i}": site(i, seen) for i in range(300)} | {f"b{i}": site(i + 1000, other) for i in range(60)}
    assert not any(B.furniture_like(B.fold(w), "") for w in other)
    df = spark.createDataFrame([(k, t, None) for k, (t, _) in made.items()], "id string, frozen string, publisher string")
    got = {(r.id, r.line_no) for r in B.main_body(df).collect() if r.id[0] == "b"}
    true = {(k, n) for k, (_, body) in made.items() if k[0] == "b" for n in body}
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got), (len(got), len(true), len(got & true))


def test_long_comments_stay_furniture():
    words = ["Home", "Search", "Menu", "Podcasts", "By Ana Silva", "Advertisement", "Most read", "Comments", "Some House", "All rights reserved"]
    text, body = site(3, words, comment="I was there and " + "heard every word of it " * 25)
    pos, lines = B.page_lines(text)
    assert {p for p, y in zip(pos, B.weak_labels(lines, None)) if y} == body


def told(n):
    """Different sentences, as told text has them."""
    nouns = "council town harbour report grant school archive office jury fund session printer tutor map vote court ledger bridge clinic library".split()
    verbs = "opened closed measured hired praised doubted funded moved counted renamed".split()
    return " ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} {random.choice(verbs)} a {random.choice(nouns)} in {random.choice(nouns)}s and the {random.choice(nouns)} {random.choice(verbs)} it by {i}." for i in range(n))


def test_spam(spark):
    random.seed(2)
    docs = [(i, told(random.randint(4, 12)), f"h{i % 4}.example") for i in range(60)]
    docs += [(100 + i, ", ".join(random.choices(["cheap tickets", "best seo agency", "robot vacuum"], k=60)), "bad.example") for i in range(30)]
    docs += [(200, "\n".join(f"{a} {b}, Chief Officer of {c}, {d} Labs" for a, b, c, d in zip("ABCDEFGHIJKLMNOPQRST", "Lima Mota Nunes Ortiz Pena Quist Rosa Silva Tavar Urze Vaz Xerez Zola Abreu Bento Costa Dias Eanes Faro Gama".split(), "Umar Vela Wess Xila Yuri Zeno Alba Bira Cora Dora Elva Fira Gila Hira Ilda Jara Kira Lara Mara Nira".split(), "Qa Wb Ec Rd Te Yf Ug Ih Oj Pk Al Sm Dn Fo Gp Hq Jr Ks Lt Zu".split())), "h1.example")]
    docs += [(300, None, "h1.example"), (301, "", None), (302, "cheap tickets", "bad.example"), (303, "   ", "x"), (304, told(6) + "\nTags: cheap, tickets, seo, agency, robot", None)]
    got = {r.doc_id: r for r in S.spam_pages(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(docs) and {k for k, r in got.items() if r.is_spam} == {100 + i for i in range(30)}
    assert S.spam_pages(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    held = rng.random((2000, 6))
    truth = (held[:, 0] > 0.5) ^ (held[:, 3] > 0.3)
    assert ((trees.boost(x, y).log_odds(held) > 0) == truth).mean() > 0.97
    assert ((trees.bag(x, y).share(held) > 0.5) == truth).mean() > 0.95


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() == df.distinct().count() or name in ("p9_passages",)


def test_spam_of_unseen_wording(spark):
    """Invented words and layouts that stand in no list: judged by what the trees learned from compression."""
    random.seed(11)
    word = lambda: "".join(random.choice(["ka", "lo", "mi", "tu", "re", "sa", "ven", "dor"]) for _ in range(3))
    people = [(i, "\n".join(f"{word().title()} {word().title()}, {word()} {word()} {word().title()}" for _ in range(20)), "h1.example") for i in range(20)]
    texts = [(100 + i, told(random.randint(5, 14)), f"h{i % 5}.example") for i in range(120)]
    spam = []
    for i in range(40):
        keys = [f"{word()} {word()}" for _ in range(3)]
        spam.append((500 + i, [" ~ ".join(random.choices(keys, k=50)), "\n".join(f"{random.choice(keys)} {random.randint(1, 99)}¥ {random.choice(keys)}" for _ in range(30)), told(2) + "\n" + " | ".join(random.choices(keys, k=60))][i % 3], "h2.example"))
    mostly_told = [(800 + i, told(9) + "\n" + " ~ ".join(word() for _ in range(12)), "h3.example") for i in range(20)]
    got = {r.doc_id for r in S.spam_pages(spark.createDataFrame(people + texts + spam + mostly_told, "doc_id long, text string, source string")).where("is_spam").collect()}
    planted = {d for d, _, _ in spam}
    assert len(got & planted) >= 0.95 * len(planted) and len(got - planted) <= 0.02 * len(got)


def test_compression_measures_are_free_of_length():
    line = (0.5, -0.1, 10.0)
    assert S.squeeze("") == (1, 0.0) and S.told_share(1024, line) == 0.5
    assert max(S.squeeze("x y z " * k)[0] for k in (10, 1000, 100_000)) <= 2 * S.WINDOW
    assert S.segment_labels(["short", "cheap tickets " * 40], 0, (0.6, 0.0, 0.0)) == [0, 1]
