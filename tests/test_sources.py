"""Readers and writers on inline fixtures."""

import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import graph as G
from tidemark.plans.evidence import threads
from tidemark.sources import readers as R
from tidemark.sources import sinks
from tidemark.sources.console import Console
from tidemark.sources.pdf import dressed, text_of
from tidemark.streaming import captures as S


def one(spark, value, cols="page string, html string"):
    return spark.createDataFrame([("p", value)], cols)


def test_files_and_register(spark, tmp_path):
    for day, name, body in (("2026-01-01", "a", "text"), ("2026-02-01", "b", "404 Not Found"), ("2026-02-01", "c", "")):
        (tmp_path / day / "g").mkdir(parents=True, exist_ok=True)
        (tmp_path / day / "g" / f"{name}.snapshot").write_text(body)
    f = R.files(spark, str(tmp_path))
    assert [r.capture for r in R.capture_dates(f).collect()] == ["2026-01-01", "2026-02-01"]
    assert R.newest_with(f, "g/a").first().capture == "2026-01-01"
    good, bad = R.register(f)
    assert [r.page for r in good.collect()] == ["g/a"] and {r.why for r in bad.collect()} == {"empty", "error body"}
    assert R.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_speaker_cards(spark):
    html = '<li id="no"><h3>X</h3></li>Confirmed speakers<ul><li id="a"><h3>Zoé &amp; Co</h3><p>Founder</p><p>Independent</p><a href="/speakers/a">x</a></li><li id="b"><h3>B</h3><p>Role</p><a href="https://www.linkedin.example/in/b">in</a></li></ul>'
    got = [tuple(r)[2:] for r in R.speaker_cards(one(spark, html)).orderBy("position").collect()]
    assert got == [("a", "Zoé & Co", "Founder", "Independent", "/speakers/a", None), ("b", "B", "Role", None, None, "https://www.linkedin.example/in/b")]


def test_agenda(spark):
    html = "<h2>Monday</h2><ul><li>9:00–9:30 – Opening. With words (Main Stage)</li><li>10:00 Side Room — Panel (talk)</li><li>9:00–9:30 – Opening. With words (Main Stage)</li><li>" + "no dash" + "</li></ul><h2>Tuesday</h2><li>9:00 — " + "x" * 200 + "</li>"
    got = {(r.day, r.start, r.end, r.stage, r.title) for r in R.agenda_rows(one(spark, html)).collect()}
    assert got == {("Monday", "9:00", "9:30", "Main Stage", "Opening."), ("Monday", "10:00", "", "Side Room", "Panel"), ("Tuesday", "9:00", "", None, "x" * 140)}


def test_feeds(spark):
    item = lambda g, d: f"<item><guid>{g}</guid><title><![CDATA[A & B]]></title><link>l</link><description><![CDATA[{d}]]></description></item>"
    feed = spark.createDataFrame([("all", item("1", "<p><strong>When:</strong> 5 March 2026<br><strong>Where:</strong> Hall</p>") + item("2", "none"))], "feed string, xml string")
    cats = spark.createDataFrame([("ai", item("1", "")), ("data", item("1", "") + item("1", ""))], "feed string, xml string")
    rows = {r.guid: r for r in R.feed_events(feed, cats).collect()}
    assert rows["1"].categories == ["ai", "data"] and str(rows["1"].date) == "2026-03-05" and rows["1"].where_ == "Hall" and rows["1"].title == "A & B"
    assert rows["2"].when_ is None and rows["2"].categories == []


def test_posts(spark):
    ld = '<script type="application/ld+json">{}</script><meta property="og:title" content="M &amp; N"><article><a href="https://x.example/a">1</a><a href="https://x.example/a">2</a></article>'
    pages = spark.createDataFrame([("o", ld.format('{"headline": "H", "author": {"name": "N"}}')), ("l", ld.format('[{"headline": "L"}]')), ("bad", ld.format("{broken"))], "page string, html string")
    rows = {r.page: r for r in R.blog_posts(pages).collect()}
    assert (rows["o"].title, rows["o"].author, rows["l"].title, rows["bad"].title) == ("H", "N", "L", "M & N") and rows["o"].links == ["https://x.example/a"]


def test_mail_cards_and_threads(spark):
    raw = "From: desk\nTo: a\nSubject: long\n  folded\nMessage-ID: <1>\nIn-Reply-To: <0>\n\nbody\n\nmore"
    r = R.mail(spark.createDataFrame([("box/entrada/x.eml", raw)], "path string, value string")).first()
    assert (r.place, r.box, r.subject, r.id, r.in_reply_to, r.body) == ("entrada", "box", "long folded", "<1>", "<0>", "body\n\nmore")
    docs = spark.createDataFrame([("a/b.md", "---\ntitulo: T\nestado: aberto\n---\ntext"), ("c-d.md", "# Head\nx"), ("e/some-name.md", "x")], "path string, value string")
    got = {x.path: (x.title, x.meta) for x in R.cards(docs).collect()}
    assert got["a/b.md"] == ("T", {"titulo": "T", "estado": "aberto"}) and got["c-d.md"][0] == "Head" and got["e/some-name.md"][0] == "Some Name"
    m = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id int, parent int")
    assert {tuple(x) for x in threads(m).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}
    inv = {x.path: x.category for x in R.inventory(docs, [("a/b", "first"), ("a", "second"), ("e/", "third")]).collect()}
    assert inv == {"a/b.md": "first", "c-d.md": "other", "e/some-name.md": "third"}


def test_threads_have_no_depth_limit(spark):
    rows = [(1, None)] + [(k, k - 1) for k in range(2, 41)] + [(50, 1), (50, 51), (51, 50)]
    got = {tuple(r) for r in threads(spark.createDataFrame(rows, "id int, parent int")).collect()}
    assert got == {(k, 1, k - 1) for k in range(1, 41)} | {(50, 1, 1), (51, 1, 2)}


def test_bundles_robots_log_and_collection(spark):
    man = spark.createDataFrame([("x", "f1", "00"), ("y", "f2", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")], "bundle string, file string, sha256 string")
    files = spark.createDataFrame([("f1", bytearray(b"y")), ("f2", bytearray(b"x"))], "file string, content binary")
    assert {r.bundle: r.ok for r in R.verified_bundles(man, files).collect()} == {"x": False, "y": True}
    rules = spark.createDataFrame([("/", True), ("/a", False), ("/a/b*", True), ("/c$", False)], "rule string, allow boolean")
    paths = spark.createDataFrame([("/a/x",), ("/a/b1",), ("/c",), ("/cd",)], "path string")
    assert {r.path: r.allowed for r in R.robots_allowed(paths, rules).collect()} == {"/a/x": False, "/a/b1": True, "/c": False, "/cd": True}
    assert R.commit_log(spark.createDataFrame([("h\td\ta\ts\tt",), ("broken",)], "value string")).first().subject == "s\tt"
    order = spark.createDataFrame([(1, "a"), (2, "b")], "n int, path string")
    with pytest.raises(PySparkException):
        R.collection(order, spark.createDataFrame([("a", "x")], "path string, value string")).collect()
    notes = spark.createDataFrame([("a", "n"), ("b", "n")], "id string, note string")
    copies = spark.createDataFrame([("a", "1", "<title>old</title>"), ("a", "2", "<title>new</title>")], "id string, capture string, html string")
    assert [r.title for r in R.coverage(notes, copies).collect()] == ["new"]


def test_load_tables(spark):
    doc = spark.createDataFrame([('{"x": {"rows": [{"a": 1, "pt": {"v": "é"}, "b": true, "l": [1, 2]}, {"a": null}]}}',)], "value string")
    spec = [{"name": "t", "file": "f", "path": "x.rows", "columns": [{"name": "a"}, {"name": "pt_v", "from": "pt.v"}, {"name": "b"}, {"name": "l"}]}]
    assert [tuple(r) for r in R.load_tables({"f": doc}, spec)["t"].collect()] == [("1", "é", "1", "[1,2]"), (None, None, None, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Órgão", 1), ("orgao", 2), ("x", 3)], "id string, v int")
    sinks.collections(rows, "things", str(tmp_path))
    assert sinks.item(spark, str(tmp_path), "things", "orgao").count() == 1
    sinks.json_document(rows, str(tmp_path / "doc"), "d", "1", "n", "rows")
    assert spark.read.json(str(tmp_path / "doc")).first()["count"] == 3
    assert '"/things/{id}.json"' in sinks.openapi({"things": rows}, "t", "1")
    t = spark.createDataFrame([("a", "p", 'q"\n\\é', "literal", "pt", None), ("a", "p", "b", "iri", None, None), ("a", "p", "true", "literal", None, "xsd:boolean")], "s string, p string, o_value string, o_kind string, o_lang string, o_datatype string")
    G.n_triples(t, "").write.text(str(tmp_path / "nt"))
    assert sorted(map(str, G.read_n_triples(spark, str(tmp_path / "nt")).collect())) == sorted(map(str, t.collect()))


def test_console_refuses_writes(spark):
    con = Console(spark)
    assert con.run("SELECT 'a;b' AS x; SELECT 2").first().x == "a;b"
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "-- c\nCREATE TABLE t (a int)"):
        with pytest.raises(ValueError):
            con.run(bad)


def test_pdf():
    def stream(body, flate=False):
        raw = zlib.compress(body) if flate else body
        return b"1 0 obj <<" + (b"/Filter /FlateDecode" if flate else b"") + b">> stream\n" + raw + b"\nendstream endobj\n"

    cmap = b"beginbfchar <0041> <00E9> endbfchar beginbfrange <0001> <0003> <0061> endbfrange"
    pdf = b"%PDF-1.4\n" + stream(b"BT (Hello \\(w\\)) Tj T* [(A) -300 (B)] TJ ET") + stream(cmap) + stream(b"BT <004100010002> Tj ET", True)
    assert text_of(pdf) == "Hello (w)\nA B\néab" and text_of(b"x") == "" and text_of(None) == ""


def made(objects, trailer=b"/Root 1 0 R"):
    """A file of the given objects; a stream is given as (dictionary, contents)."""
    out = b"%PDF-1.7\n"
    for k, o in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o if isinstance(o, bytes) else b"<<%s /Length %d>>\nstream\r\n%s\nendstream" % (o[0], len(o[1]), o[1]))
    return out + b"trailer <<%s>>\n" % trailer


TREE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 8 0 R] /Count 2 /Resources 9 0 R>>", 3: b"<</Type /Page /Contents [4 0 R 10 0 R]>>", 8: b"<</Type /Page /Contents 11 0 R>>"}


def test_pdf_fonts_and_pages():
    """Two fonts with maps of their own, of one and two bytes, encodings by glyph names, pages in the order of the tree."""
    one = (b"", b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <24> <26> <0041> endbfrange")
    two = (b"", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0002> [<00660069> <00E9>] endbfrange 1 beginbfchar <0024> <D83DDE00> endbfchar")
    body = {
        **TREE, 4: (b"", b"BT /A 9 Tf ($%&) Tj <2425> Tj 1 0 0 1 5 700 Tm /B 9 Tf [<0001> -300 <0002>] TJ /C 9 Tf 0 -12 Td (\\351\\(x (y)\\)) Tj ET".replace(b"\\\\", b"\\")), 10: (b"", b"BT /A 9 Tf (\\46) Tj /B 9 Tf <0024> Tj ET /F Do".replace(b"\\\\", b"\\")),
        11: (b"", b"% second (page)\nBT /D 9 Tf <0141424304> Tj ET BI /W 1 ID (not) Tj EI BT /A 1 Tf (&) ' ET"), 9: b"<</Font <</A 5 0 R /B 6 0 R /C 7 0 R /D 12 0 R>> /XObject <</F 15 0 R>>>>",
        5: b"<</Type /Font /Subtype /TrueType /ToUnicode 13 0 R>>", 6: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 14 0 R>>", 7: b"<</Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding>>",
        12: b"<</Type /Font /Subtype /Type1 /Encoding <</Differences [1 /eacute 4 /uni20AC 66 /five.alt]>>>>", 13: one, 14: two, 15: (b"/Type /XObject /Subtype /Form", b"BT /C 1 Tf (form) Tj ET"),
    }
    assert text_of(made(body)) == "ABCAB\nfi é\né(x (y))\nC\U0001f600\nform\néA5C€\nC"


def test_pdf_object_streams_and_damage():
    inner = b"1 0 2 31 3 80 " + b"<</Type /Catalog /Pages 2 0 R>>".ljust(31) + b"<</Type /Pages /Kids [3 0 R] /Count 1>>".ljust(49) + b"<</Type /Page /Contents 4 0 R /Resources <<>>>>"
    packed = zlib.compress(inner)
    body = {20: (b"/Type /ObjStm /N 3 /First 14 /Filter /FlateDecode", packed), 4: (b"", b"BT (packed) Tj ET")}
    assert text_of(made(body)) == "packed"
    assert text_of(made({**body, 4: b"<</Length 99>>\nstream\nBT (no length) Tj ET\nendstream"})) == "no length"
    assert text_of(b"%PDF-1.4 1 0 obj <</A [1 2 (open") == "" and text_of(made({4: (b"/Filter /FlateDecode", b"broken")})) == ""


@pytest.mark.parametrize("kind", ["rc4-40", "rc4-128", "aes-128", "aes-256-r5", "aes-256-r6"])
def test_encrypted_pdf(kind):
    """Files locked with an empty user password are read; others give no text. Keys are made here from the standard."""
    import hashlib

    from tidemark.sources import pdf as P

    ident, owner, flags, plain = b"0123456789abcdef", bytes(range(32)), -44, b"BT (secret text) Tj ET"
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /Count 1>>", 3: b"<</Type /Page /Contents 4 0 R /Resources <<>>>>"}

    def locked(password):
        pad = (password + P.PADDING)[:32]
        iv, filled = b"i" * 16, plain + bytes([16 - len(plain) % 16]) * (16 - len(plain) % 16)
        if kind.startswith("aes-256"):
            file_key, hashed = b"k" * 32, (lambda salt: P._hash_r6(password, salt, b"")) if kind.endswith("6") else (lambda salt: hashlib.sha256(password + salt).digest())
            user = hashed(b"validate") + b"validate" + b"keysalt_"
            info = b"/V 5 /R %d /Length 256 /U <%s> /UE <%s> /CF <</S <</CFM /AESV3>>>> /StmF /S" % (int(kind[-1]), user.hex().encode(), P.Aes(hashed(b"keysalt_")).encrypt(file_key, bytes(16)).hex().encode())
            return info, iv + P.Aes(file_key).encrypt(filled, iv)
        n, rounds = (5, 0) if kind == "rc4-40" else (16, 50)
        key = hashlib.md5(pad + owner + (flags & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
        for _ in range(rounds):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        user = P.rc4(key, P.PADDING)
        if rounds:
            user = hashlib.md5(P.PADDING + ident).digest()
            for i in range(20):
                user = P.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
        own = hashlib.md5(key + (4).to_bytes(3, "little") + bytes(2) + (b"sAlT" if kind.startswith("aes") else b"")).digest()[: min(n + 5, 16)]
        info = {"rc4-40": b"/V 1 /R 2", "rc4-128": b"/V 2 /R 3 /Length 128", "aes-128": b"/V 4 /R 4 /CF <</StdCF <</CFM /AESV2>>>> /StmF /StdCF"}[kind]
        return info + b" /U <%s>" % user.hex().encode(), P.rc4(own, plain) if kind.startswith("rc4") else iv + P.Aes(own).encrypt(filled, iv)

    for password, want in ((b"", "secret text"), (b"other", "")):
        info, data = locked(password)
        trailer = b"/Root 1 0 R /ID [<%s> <00>] /Encrypt <</Filter /Standard /O <%s> /P %d %s>>" % (ident.hex().encode(), owner.hex().encode(), flags, info)
        assert text_of(made({**objects, 4: (b"", data)}, trailer)) == want
    # published vectors of the ciphers
    assert P.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        block = P.Aes(bytes(range(size)))
        assert block.block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == want and block.unblock(bytes.fromhex(want)).hex() == "00112233445566778899aabbccddeeff"


@pytest.mark.parametrize("flate", [False, True])
def test_dressed_pdf_gives_the_text_back(spark, flate):
    texts = ["plain", "a (b) c) ( \\ d\\n \\101", "two\nlines\r\nof it", "ação é ÿ", "— «Olá» € 1 (x)", "日本 𝒳 \\ end", "[x] TJ (y) Tj <41> ET", ""]
    for x in texts:
        assert text_of(dressed(x, flate)) == x


def test_pdf_takes_every_text(spark, tmp_path):
    from tidemark.plans import catalogue

    spark.createDataFrame([(1, "é (a)\n\nb\\"), (2, "—  x "), (3, None), (4, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in catalogue.QUERIES["src18_pdf"](spark, str(tmp_path)).collect()} == {(1, "é (a)\nb\\"), (2, "— x"), (4, "")}


def test_dressed_rows_are_escaped_and_all_read(spark, tmp_path):
    from tidemark.plans import catalogue

    spark.createDataFrame([("a", "A & B <c>", "R&D &amp; x"), ("b", "B", None), ("c", "C", "x")], "id string, name string, role string").write.parquet(str(tmp_path / "people.parquet"))
    spark.createDataFrame([(1, "x </noscript> & &lt; # @ 3 maio"), (2, "#1"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda n: {tuple(r) for r in catalogue.QUERIES[n](spark, str(tmp_path)).collect()}
    assert run("src08_speaker_cards") == {("a", "A & B <c>", "R&D &amp; x"), ("b", "B", None), ("c", "C", "x")}
    assert run("tx02_largest_noscript") == {(1, 31), (2, 3)} and run("tx25_mask_and_fill") == {(1, True), (2, True)}


def test_excerpts():
    long = "a" * 40 + " middle " + "b" * 40 + " and more " + "c" * 40
    assert X.locate_excerpt("middle", long) == ("exacta", 1)
    assert X.locate_excerpt("a" * 35 + " " + "b" * 35, long)[0] is not None
    assert X.locate_excerpt("a" * 40 + "zz", long)[0] is None
    assert X.locate_excerpt("x" * 29 + "a" * 40, long)[0] is None
    assert X.locate_excerpt(None, long) == (None, 0)


def test_excerpts_against_all_ways_to_cut():
    """The fewest ordered pieces, found by trying every cut and every place."""
    import random

    def tried(asked, given, least, most):
        skip = lambda i: i + len(asked[i:]) - len(asked[i:].lstrip())
        reached, end = {(skip(0), 0)}, len(asked.rstrip())
        for n in range(1, most + 1):
            reached = {(skip(j), p + j - i) for i, b in reached for p in range(b, len(given)) for j in range(i + least, len(asked) + 1) if asked[i:j] == given[p : p + j - i]}
            if any(j >= end for j, _ in reached):
                return "fragmentada", n
            if not reached:
                return None, n - 1
        return None, most

    rng = random.Random(2)
    for _ in range(600):
        given = "".join(rng.choice("aab b") for _ in range(rng.randint(1, 40))).strip()
        asked = " ".join(given[a : a + rng.randint(1, 14)] for a in sorted(rng.choices(range(len(given) + 1), k=3))).strip()
        if asked and asked not in given:
            got, want = X.locate_excerpt(asked, given, least=4), tried(asked, given, 4, 3)
            assert got == want or (got[0] is None and want[0] is None), (asked, given)


def test_text_functions(spark):
    r = one(spark, "<p>A&nbsp;&amp; <script>no</script>B</p>").select(X.visible(F.col("html")).alias("v"), X.slug(F.lit("Órgão ß 1!")).alias("s"), X.raw_slug(F.lit("Órgão")).alias("r"), X.slug(F.lit("—")).alias("e"), X.level(F.lit("«Olá» — ( a ) .")).alias("l"), X.domain(F.lit("HTTPS://www.A.example:80/x?y")).alias("d"), X.fill(X.mask(F.lit("a 12 de maio b")), X.masked_values(F.lit("a 12 de maio b"))).alias("f")).first()
    assert (r.v, r.s, r.r, r.e, r.d, r.f) == ("A & B", "orgao-1", "rg-o", "sem-nome", "a.example:80", "a 12 de maio b") and r.l == '"olá" - (a).'
    assert X.link_entities("AI Lab and <a>AI Lab</a> `AI` then AI", {"AI": "x", "AI Lab": "y"}) == [("AI Lab", "y", 0), ("AI", "x", 35)]


def test_mask_against_brute_force(spark):
    import re

    words = X.MONTHS_DAYS.split("|")
    texts = ["Terça-feira, 3 de Março de 2026", "MARÇO março sábado 12", "maiores maio2024 2maio", "Mayor of May, may_be", "Sábado—domingo", "#1 no @ de maio, a@b.example", "ágosto\nagosto", "٣ de junho", "", "dia 1 000", "segunda-feira-feira"]

    def brute(text):
        out, took, i = "", [], 0
        letter = lambda k: 0 <= k < len(text) and (text[k].isalpha() or text[k] == "_")
        while i < len(text):
            hit = re.match("[0-9]+", text[i:])
            word = next((w for w in words if text[i : i + len(w)].lower() == w and not letter(i - 1) and not letter(i + len(w))), "")
            took += [hit.group()] if hit else [text[i : i + len(word)]] if word else [text[i]] if text[i] in "#@" else []
            out += "#" if hit else "@" if word else text[i]
            i += len(hit.group()) if hit else len(word) or 1
        return out, took

    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", X.mask(F.col("text")).alias("m"), X.masked_values(F.col("text")).alias("v"), X.fill(X.mask(F.col("text")), X.masked_values(F.col("text"))).alias("f")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.m, r.v) == brute(r.text) and r.f == r.text
    assert next(r.m for r in rows if r.text.startswith("Terça")) == "@, # de @ de #"


def test_mask_takes_every_text(spark, tmp_path):
    from tidemark.plans import catalogue

    spark.createDataFrame([(1, "3 de março"), (2, "plain 7"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in catalogue.QUERIES["tx25_mask"](spark, str(tmp_path)).collect()} == {(1, "# de @"), (2, "plain #")}


def test_distance_has_no_limit(spark):
    e = spark.createDataFrame([(f"n{i}", "v", f"n{i + 1}") for i in range(8)] + [("x", "v", "y")], "source string, verb string, target string")
    assert G.distance(e, "n0", "n8").first().length == 8
    assert G.distance(e, "n0", "x").first().length is None and G.distance(e, "n0", "n8", 4).first().length is None


def test_graph(spark):
    e = spark.createDataFrame([("a", "v", "b"), ("b", "v", "c"), ("c", "w", "d"), ("a", "v", "a"), ("x", "v", "y")], "source string, verb string, target string")
    assert {tuple(r) for r in G.degree(e).collect()} == {("a", 2), ("b", 2), ("c", 2), ("d", 1), ("x", 1), ("y", 1)}
    assert {tuple(r) for r in G.within_hops(e, spark.createDataFrame([("a",)], "id string"), 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert G.distance(e, "a", "d").first().length == 3 and G.distance(e, "a", "x").first().length is None and G.distance(e, "a", "a").first().length == 0
    n = spark.createDataFrame([(i,) for i in "abcdxy"], "id string")
    paths = G.path_pattern(e, n, F.col("id") == "a", [("v", "out", None), (None, "both", None)])
    assert {(r.n0, r.n1, r.n2) for r in paths.collect()} == {("a", "b", "c")}
    assert {tuple(r) for r in G.collapse(e, spark.createDataFrame([("b",), ("c",)], "id string"), "g").collect()} == {("a", "v", "g"), ("g", "w", "d"), ("a", "v", "a"), ("x", "v", "y")}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2026-01-01 00:{i % 60:02d}:00", i % 3, "a", 1.0) for i in range(60)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = S.each_increment(S.read_captures(spark, str(tmp_path / "in"), rows.schema, 1), lambda df, k: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 60 and len(seen) == 3
    assert S.only_new(rows, rows.where("event_id < 50"), "event_id").count() == 10
    assert sum(r.n for r in S.sessions(rows).collect()) == 60


def test_planted_damage(spark, tmp_path):
    """Gates fail on damage planted for them."""
    from tidemark.plans import catalogue

    for name, rows, schema in (
        ("nodes", [("person:a", "Person", "A"), ("topic:t", "Topic", "T")], "id string, type string, label string"),
        ("edges", [("e1", "offers", "person:a", "topic:t"), ("e2", "speaks_on", "person:a", "topic:none")], "id string, verb string, source string, target string"),
    ):
        df = spark.createDataFrame(rows, schema).withColumn("recorded", F.lit("2026-01-01").cast("timestamp_ntz"))
        for c in ("pack", "source", "role", "org") if name == "nodes" else ("pack",):
            df = df.withColumn(c, F.lit(None).cast("string"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {tuple(r) for r in catalogue.QUERIES["gt10_ontology"](spark, str(tmp_path)).collect()} == {("e1", "range")}
    assert {(r.id, r.bad_target) for r in catalogue.QUERIES["gr20_dangling"](spark, str(tmp_path)).collect()} == {("e2", True)}
