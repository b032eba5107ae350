"""Mapping of freely typed values to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join
from tidemark.session import as_table

#: Accented letters and what they fold to (fixed values, in pairs).
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyaaaaaaeeeeiiiiooooouuuucny"
#: Where the organisation begins after a title.
TAIL = r"(?i)\s+(@|\||–|—|-|at|na|no)\s+.*$"
#: A reference list is a fixed vocabulary; its variants go to every task.
MAX_ENTRIES = 20_000

#: Wordings learned from records: so many witnesses at least, and this share of them for one entry
#: (two witnesses are added to the total, so that few must agree more than many).
WITNESSES, SHARE = 3, 0.6
#: ... and so many standard deviations more than such a share would come by chance.
DEVIATIONS = 3.0
#: Words that only connect the words of a title (fixed values).
CONNECTIVES = "and or the of in for to e ou o a os as de da do dos das em para".split()


def plain(text: str) -> str:
    """The driver's twin of plain_column(), for the reference list."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    t = re.sub(r"\.(?=[a-z])", "", t).replace("&", " and ").replace("+", " and ")
    t = re.sub(r"\bco[- ](?=f(?:ou|u)n)", "co", t)
    return " ".join(re.sub(r"[^a-z0-9]+", " ", t).split())


def plain_column(c: Column) -> Column:
    """Lower case, without accents, dots inside abbreviations and punctuation; '&' is a word; blanks collapse."""
    c = F.regexp_replace(F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), ACCENTED, PLAIN)), r"\.(?=[a-z])", "")
    c = F.regexp_replace(F.regexp_replace(c, "[&+]", " and "), r"\bco[- ](?=f(ou|u)n)", "co")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


#: Masculine endings of Portuguese titles and their feminine forms (fixed values).
GENDERED = {"or": "ora", "io": "ia", "ro": "ra", "vo": "va", "co": "ca", "do": "da"}


def _feminine(p: str) -> str:
    def of(w: str, last: bool) -> str:
        e = w[-2:]
        return w[:-2] + GENDERED[e] if e in GENDERED and len(w) > 3 else w

    head, _, tail = p.partition(" de ")
    return " ".join(of(w, False) for w in head.split()) + (" de " + tail if tail else "")


def variants(label: str | None, pt: str | None, short: str | None) -> set[str]:
    """Plain wordings of an entry by rule: labels, word order, 'X of Y', shortened first words, gender."""
    out: set[str] = set()
    english = {plain(x) for x in (label, short) if x}
    for p in english:
        out.add(p)
        w = p.split()
        if len(w) == 3 and w[0] == "chief" and w[2] == "officer":
            out |= {f"chief {w[1]}", f"chief of {w[1]}", f"officer chief {w[1]}", f"chief officer {w[1]}", f"chief {w[1]} off"}
        elif len(w) >= 3 and w[0] == "head" and w[1] == "of":
            x = " ".join(w[2:])
            out |= {f"head {x}", f"{x} head", f"{x} lead", f"head of {x}", f"lead {x}"}
        elif len(w) in (2, 3) and "and" not in w and "of" not in w and w[0] not in ("chief", "head"):
            last, rest = w[-1], " ".join(w[:-1])
            out |= {f"{last} {rest}", f"{last} of {rest}"}
            if label and p == plain(label):
                out |= {f"{w[0][:k]} {' '.join(w[1:])}" for k in (3, 4, 5, 6) if k < len(w[0]) - 1}
                out |= {f"{rest} {last[:k]}" for k in (3, 4) if k < len(last) - 1}
    if pt:
        p = plain(pt)
        out |= {p, _feminine(p)}
        if "inteligencia artificial" in p:
            out.add(p.replace("inteligencia artificial", "ia"))
        w = p.split()
        if len(w) > 2 and w[1] in ("de", "da", "do"):
            out.add(f"{w[0]} {' '.join(w[2:])}")
    out |= {"co " + x[2:] for x in out if x.startswith(("cofo", "cofu"))}
    return {x for x in out if x}


def allowed(length: int) -> int:
    """Errors allowed in a wording of so many letters."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 12 else 3 if length < 16 else 4


def reference(entries: list[tuple[str, str, str | None, str | None, str | None]]) -> list[tuple[str, str, str]]:
    """(field, entry, wording) of (field, entry, label, pt, short); a wording that two entries share goes to the one whose label it is, else the first."""
    own: dict[tuple[str, str], str] = {}
    for field, entry, label, pt, short in entries:
        for p in (label, short, pt, entry.replace("-", " ")):
            if p and plain(p):
                own.setdefault((field, plain(p)), entry)
    for field, entry, label, pt, short in entries:
        for p in sorted(variants(label, pt, short)):
            own.setdefault((field, p), entry)
    return [(f, e, p) for (f, p), e in sorted(own.items())]


def counterparts(entries: list[tuple[str, str, str | None, str | None, str | None]]) -> list[tuple[str, str, str]]:
    """(field, a, b): words of the two languages of a list that stand for each other.

    They are the two words left over when an entry's label and its translation
    lose the words they share and the connectives.
    """
    out = set()
    for field, _, label, pt, _ in entries:
        if label and pt:
            a, b = (set(plain(x).split()) - set(CONNECTIVES) for x in (label, pt))
            if len(a - b) == len(b - a) == 1:
                (x,), (y,) = a - b, b - a
                out |= {(field, x, y), (field, y, x), (field, _feminine(y), x), (field, x, _feminine(y))}
    return sorted(out)


#: allowed() as an expression of a length.
ALLOWED = "CASE WHEN {n} < 5 THEN 0 WHEN {n} < 8 THEN 1 WHEN {n} < 12 THEN 2 WHEN {n} < 16 THEN 3 ELSE 4 END"
#: Start (from 0) and length of segment i of a wording of n letters, cut into k + 1.
START = "(i * (n div (k + 1)) + greatest(0, i - (k + 1 - n % (k + 1))))"
SIZE = "(n div (k + 1) + CAST(i >= k + 1 - n % (k + 1) AS INT))"


def segments(wordings: DataFrame) -> DataFrame:
    """(field, n, i, seg, entry, wording, k, weight): wordings of n letters with k allowed errors in k + 1 segments.

    Of any text within k errors at least one segment stands unchanged, at most k places away.
    """
    cut = wordings.withColumn("n", F.length("wording")).withColumn("k", F.expr(ALLOWED.format(n="n"))).where("k > 0 AND fuzzy")
    each = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    return each.withColumn("seg", F.expr(f"substring(wording, {START} + 1, {SIZE})")).select("field", "n", "i", "seg", "entry", "wording", "k", "weight")


def probes(forms: DataFrame, lengths: list[int]) -> DataFrame:
    """(field, form, n, i, seg), distinct: substrings of a form that may be segment i of a wording of n letters.

    Made from the length of the form by expression, whatever the size of the
    list; `lengths` are those the list has. A shift that leaves more errors
    than allowed to both sides can't be.
    """
    known = f"array({', '.join(map(str, lengths))})"
    sized = forms.withColumn("plen", F.length("form")).withColumn("n", F.expr(f"explode(filter({known}, n -> abs(n - plen) <= {ALLOWED.format(n='n')}))"))
    each = sized.withColumn("k", F.expr(ALLOWED.format(n="n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    each = each.withColumn("at", F.expr(START)).withColumn("size", F.expr(SIZE))
    shifts = "filter(sequence(-k, k), s -> abs(s) + abs(plen - n - s) <= k AND at + s >= 0 AND at + s + size <= plen)"
    return each.select("field", "form", "n", "i", F.expr(f"explode(array_distinct(transform({shifts}, s -> substring(form, at + s + 1, size))))").alias("seg"))


def formed(values: DataFrame) -> DataFrame:
    """(field, value, form, rank, last): the value and what stands before an organisation in it, folded; rank 0 is the whole."""
    cut = F.regexp_replace("value", TAIL, "")
    comma = F.regexp_replace(cut, r",[^,]*$", "")
    forms = [(0, F.col("value")), (2, cut), (4, comma), (6, F.regexp_replace(comma, r",[^,]*$", "")), (8, F.regexp_replace("value", r",[^,]*$", ""))]
    ranked = F.array(*[F.struct(F.lit(r).alias("rank"), plain_column(f).alias("form")) for r, f in forms])
    return values.select("field", "value", F.inline(ranked)).where("form <> ''").groupBy("field", "value", "form").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"))


def rule_wordings(spark: SparkSession, entries: list[tuple[str, str, str | None, str | None, str | None]]) -> DataFrame:
    """(field, entry, wording, weight, fuzzy): the wordings that follow from the list by rule."""
    return spark.createDataFrame([(f, e, p, None, True) for f, e, p in reference(entries)], "field string, entry string, wording string, weight long, fuzzy boolean")


def exact(forms: DataFrame, wordings: DataFrame) -> DataFrame:
    """(field, value, rank, entry): forms that are a wording."""
    return forms.join(wordings.select("field", F.col("wording").alias("form"), "entry"), ["field", "form"]).select("field", "value", "rank", "entry")


def map_values(values: DataFrame, entries: list[tuple[str, str, str | None, str | None, str | None]], learned: DataFrame | None = None, patterns: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """(field, value, entry) of distinct (field, value): the entry meant, or 'none'.

    Only built-in functions: the value and what stands before an organisation
    in it are folded, matched exactly, then with the patterns of the list, and
    else by the pigeonhole join verified with levenshtein. The longest form
    wins, exact before near, then the fewest errors, then the wording with more
    witnesses, then the first entry; what no form reaches is reported by
    anti-join. `learned` has the columns of rule_wordings(), `patterns` is
    (field, entry, pattern); a value that patterns of two entries match is
    settled by neither.
    """
    spark = values.sparkSession
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    wordings = rule_wordings(spark, entries)
    wordings = as_table(wordings if learned is None else wordings.unionByName(learned), "wordings")
    forms = formed(values) if forms is None else forms
    hit = exact(forms, wordings).select("field", "value", "rank", F.lit(0).alias("errors"), F.lit(0).cast("long").alias("against"), "entry")
    if patterns is not None:
        found = values.join(patterns, "field").where(F.expr("value RLIKE concat('(?i)', pattern)")).groupBy("field", "value").agg(F.min("entry").alias("entry"), F.max("entry").alias("_z")).where("entry = _z")
        hit = hit.unionByName(found.select("field", "value", F.lit(1).alias("rank"), F.lit(0).alias("errors"), F.lit(0).cast("long").alias("against"), "entry"))
    # the words of the whole value in another order, or shortened, say more than its beginning alone
    hit = as_table(hit, "exact-hits")
    open_ = forms.where("rank = 0").join(hit.where("rank <= 1").select("field", "value").distinct(), ["field", "value"], "left_anti")
    by_rule = wordings.where("weight IS NULL")
    same = spark.createDataFrame(counterparts(entries), "field string, a string, b string")
    for found, add in ((by_words(forms.join(open_.select("field", "value"), ["field", "value"]), by_rule, same), 1), (by_head(open_, by_rule).withColumn("errors", F.lit(0)), 30)):
        hit = hit.unionByName(forms.join(found, ["field", "form"]).select("field", "value", (F.col("rank") + add).alias("rank"), F.col("errors").cast("int").alias("errors"), F.lit(0).cast("long").alias("against"), "entry"))
    hit = as_table(hit, "hits")
    # a value whose longest form is known needs no search
    known = hit.where("rank <= 1").select("field", "value").distinct()
    rest = as_table(forms.join(known, ["field", "value"], "left_anti"), "unknown-forms")
    left = rest.select("field", "form", F.lit(False).alias("sorted"), F.col("form").alias("_f")).distinct()
    in_order = lambda df, name: df.select("*", F.concat_ws(" ", words_of(F.col(name))).alias("_w")).where("_w <> '' AND size(split(_w, ' ')) > 1")
    asked = left.unionByName(in_order(left, "form").select("field", "form", F.lit(True).alias("sorted"), F.col("_w").alias("_f"))).withColumn("field_", F.concat("field", F.when(F.col("sorted"), F.lit("#")).otherwise(F.lit(""))))
    stored = wordings.unionByName(in_order(wordings, "wording").select(F.concat("field", F.lit("#")).alias("field"), "entry", F.col("_w").alias("wording"), "weight", "fuzzy").distinct())
    lengths = [r.n for r in stored.select(F.length("wording").alias("n")).distinct().orderBy("n").collect() if r.n >= 5]
    near = (
        probes(asked.select(F.col("field_").alias("field"), F.col("_f").alias("form")).distinct(), lengths or [0])
        .join(segments(stored), ["field", "n", "i", "seg"])
        .withColumn("errors", F.levenshtein("form", "wording"))
        .where(F.col("errors") <= F.col("k"))
        .groupBy(F.col("field").alias("field_"), F.col("form").alias("_f"))
        .agg(F.min(F.struct("errors", (-F.coalesce("weight", F.lit(0))).alias("against"), "entry")).alias("_m"))
        .join(asked, ["field_", "_f"])
        .groupBy("field", "form")
        .agg(F.min(F.struct("_m.errors", "sorted", "_m.against", "_m.entry")).alias("_m"))
        .select("field", "form", "_m.errors", "_m.against", "_m.entry")
    )
    whole_only = (F.col("rank") == 0) & (F.col("last") == 0)  # something stands behind a separator: the whole is searched last
    late = F.when(whole_only, F.lit(20)).otherwise(F.greatest("rank", F.lit(2)) + 1)
    fuzzy = rest.join(near, ["field", "form"]).select("field", "value", late.alias("rank"), "errors", "against", "entry")
    best = hit.unionByName(fuzzy).groupBy("field", "value").agg(F.min(F.struct("rank", "errors", "against", "entry")).alias("_b")).select("field", "value", F.col("_b.entry").alias("entry"))
    best = as_table(best, "best-entries")
    none = values.select("field", "value").join(best, ["field", "value"], "left_anti").select("field", "value", F.lit("none").alias("entry"))
    return best.unionByName(none)


def learn(votes: DataFrame, least: int, fuzzy_from: int) -> DataFrame:
    """Wordings from (field, form, entry, who): the entry that most witnesses of a form stand for.

    SHARE of the witnesses must stand for it, DEVIATIONS more than among the
    witnesses of all forms of the field.
    """
    n = as_table(votes.groupBy("field", "form", "entry").agg(F.count_distinct("who").alias("n")), "votes")
    per_entry = n.groupBy("field", "entry").agg(F.sum("n").alias("_e"))
    base = per_entry.join(per_entry.groupBy("field").agg(F.sum("_e").alias("_all")), "field").select("field", "entry", (F.col("_e") / F.col("_all")).alias("base"))
    top = n.groupBy("field", "form").agg(F.sum("n").alias("total"), F.max(F.struct("n", "entry")).alias("t")).select("field", "form", "total", "t.n", "t.entry")
    chance = F.col("total") * F.col("base")
    sure = top.join(base, ["field", "entry"]).where((F.col("n") >= least) & (F.col("n") >= SHARE * (F.col("total") + (2 if least > 1 else 0))) & (F.col("n") - chance >= DEVIATIONS * F.sqrt(chance * (1 - F.col("base")))))
    return sure.select("field", "entry", F.col("form").alias("wording"), F.col("n").alias("weight"), (F.col("n") >= fuzzy_from).alias("fuzzy"))


def words_of(c: Column) -> Column:
    """The distinct words of a folded text without connectives, in order of letters."""
    return F.sort_array(F.array_except(F.split(c, " "), F.array(*[F.lit(w) for w in CONNECTIVES])))


def by_words(forms: DataFrame, wordings: DataFrame, same_words: DataFrame) -> DataFrame:
    """(field, form, errors, entry): forms that consist of the words of one entry's wording, in any order, shortened or not.

    A word stands for another if it is the same (0 errors), the other with
    'co' before it, its beginning of 3 letters or more, its consonants, its
    counterpart in the other language, or another derivation of a word of 6
    letters or more with the same first 5 (1 error). Every word of the form must find its own word of the wording and
    every word of the wording must be found; a form that fits two entries is
    settled by neither. Joins are on words, beginnings and initials by equality.
    """
    bags = wordings.select("field", "entry", words_of(F.col("wording")).alias("words")).where("size(words) > 0").distinct()
    bags = as_table(bags.withColumn("size", F.size("words")).withColumn("bag", F.concat_ws(" ", "words")), "listed-words")
    words = bags.select("field", F.explode("words").alias("word")).distinct()
    asked = as_table(forms.select("field", "form", words_of(F.col("form")).alias("_w")).distinct().withColumn("size", F.size("_w")).where("size > 0"), "asked-words")
    token = asked.select("field", F.explode("_w").alias("token")).distinct()
    n = F.length("word")
    begins = words.select("field", "word", F.explode(F.expr("transform(filter(sequence(3, greatest(3, length(word) - 1)), k -> k < length(word)), k -> substring(word, 1, k))")).alias("token"))
    derived = token.where("length(token) >= 6").withColumn("_p", F.substring("token", 1, 5)).join(words.where(n >= 6).withColumn("_p", F.substring("word", 1, 5)), ["field", "_p"]).select("field", "token", "word")
    bare = token.where("token RLIKE '^[bcdfghjklmnpqrstvwxz]{3,}$'").withColumn("_p", F.substring("token", 1, 1))
    consonants = bare.join(words.withColumn("_p", F.substring("word", 1, 1)), ["field", "_p"]).where(F.expr("length(word) > length(token) AND word RLIKE concat('^', array_join(split(token, ''), '.*'))")).select("field", "token", "word")
    loose = begins.unionByName(words.select("field", "word", F.concat(F.lit("co"), "word").alias("token"))).join(token, ["field", "token"]).unionByName(derived).unionByName(consonants)
    same = same_words.select("field", F.col("b").alias("word"), F.col("a").alias("token"))
    loose = loose.unionByName(same.join(token, ["field", "token"]).select("field", "word", "token")).unionByName(same.select("field", "word", F.concat(F.lit("co"), "token").alias("token")).join(token, ["field", "token"]).select("field", "word", "token"))
    alike = words.select("field", "word", F.col("word").alias("token"), F.lit(0).alias("e")).unionByName(loose.select("field", "word", "token", F.lit(1).alias("e")))
    alike = as_table(alike.groupBy("field", "token", "word").agg(F.min("e").alias("e")), "alike-words")
    of_form = asked.select("field", "form", "size", F.explode("_w").alias("token"))
    of_bag = bags.select("field", "entry", "bag", "size", F.explode("words").alias("word"))
    met = of_form.join(alike, ["field", "token"]).join(of_bag, ["field", "size", "word"])
    whole = met.groupBy("field", "form", "entry", "bag", "size").agg(F.count_distinct("token").alias("_t"), F.count_distinct("word").alias("_b"), F.sum("e").alias("errors")).where("_t = size AND _b = size")
    each = as_table(whole.groupBy("field", "form", "entry").agg(F.min("errors").alias("errors")), "same-words")
    least = each.groupBy("field", "form").agg(F.min("errors").alias("errors"))
    best = each.join(least, ["field", "form", "errors"]).groupBy("field", "form", "errors").agg(F.min("entry").alias("entry"), F.max("entry").alias("_z"))
    return best.where("entry = _z").select("field", "form", "errors", "entry")


def by_head(forms: DataFrame, wordings: DataFrame) -> DataFrame:
    """(field, form, entry): forms whose head is an entry of one word, or several of it: the last word, or the first before de, da, do, em."""
    one = wordings.where("wording RLIKE '^[a-z]{5,}$'")
    heads = one.select("field", F.col("wording").alias("head"), "entry").unionByName(one.select("field", F.concat("wording", F.lit("s")).alias("head"), "entry"))
    last = forms.where("form LIKE '% %'").select("field", "form", F.regexp_extract("form", r"([a-z]+)$", 1).alias("head"))
    first = forms.select("field", "form", F.regexp_extract("form", r"^([a-z]+) (?:de|da|do|em) ", 1).alias("head"))
    return last.unionByName(first).where("head <> ''").join(heads, ["field", "head"]).groupBy("field", "form").agg(F.min("entry").alias("entry"), F.max("entry").alias("_z")).where("entry = _z").select("field", "form", "entry")


def learned_wordings(rows: DataFrame, forms: DataFrame, wordings: DataFrame, tags: DataFrame, role_list: DataFrame) -> DataFrame:
    """Wordings that no rule gives, from what is known about the records that hold them.

    A matched word is witnessed by the persons for whom somebody has tagged it;
    a title by the persons who hold a known title in another capture; a class
    by the persons whose known titles belong to a class. Values that mean no
    entry stand with all kinds of persons, so no entry gets its SHARE.
    """
    wordings = as_table(wordings, "rule-wordings")
    seeds = exact(forms, wordings).groupBy("field", "value").agg(F.min(F.struct("rank", "entry")).alias("_b")).select("field", "value", F.col("_b.entry").alias("entry"))
    whole = forms.where("rank = 0").select("field", "value", "form")
    open_ = whole.join(wordings.select("field", F.col("wording").alias("form")), ["field", "form"], "left_anti")
    profile = salted_join(rows.where("field = 'people.role'"), seeds, ["field", "value"], "inner").select(F.col("rec").alias("who"), "entry", F.col("value").alias("said")).distinct()
    asked = salted_join(rows.where("field IN ('people.role', 'nodes.role_class')"), open_, ["field", "value"], "inner").select("field", "value", "form", F.when(F.col("field") == "people.role", F.col("rec")).otherwise(F.regexp_replace("rec", "^person:", "")).alias("who")).distinct()
    classes = role_list.where("kind = 'role'").select("entry", "role_class").distinct()
    votes = asked.join(profile, "who").where("field <> 'people.role' OR value <> said")  # a value is no witness of itself
    roles = votes.where("field = 'people.role'").select("field", "form", "entry", "who")
    of_class = votes.where("field = 'nodes.role_class'").join(classes, "entry").select("field", "form", F.col("role_class").alias("entry"), "who").distinct()
    tagged = tags.where("tag IS NOT NULL AND matched IS NOT NULL AND person IS NOT NULL").select(F.lit("person_tags.matched").alias("field"), plain_column(F.col("matched")).alias("form"), F.col("tag").alias("entry"), F.col("person").alias("who")).where("form <> ''")
    tagged = tagged.join(wordings.select("field", F.col("wording").alias("form")), ["field", "form"], "left_anti")
    return learn(roles.unionByName(of_class), WITNESSES, WITNESSES).unionByName(learn(tagged, 1, WITNESSES))


def free_values(people: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """(field, rec, value), distinct: non-blank free values of the three fields, as stored."""
    rows = (
        people.where("id IS NOT NULL").select(F.lit("people.role").alias("field"), F.col("id").alias("rec"), F.col("role").alias("value"))
        .unionByName(nodes.select(F.lit("nodes.role_class").alias("field"), F.col("id").alias("rec"), F.col("role_class").alias("value")))
        .unionByName(tags.where("tag IS NULL").select(F.lit("person_tags.matched").alias("field"), F.col("person").alias("rec"), F.col("matched").alias("value")))
    )
    return rows.where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S")).distinct()


def entries_of(role_list: DataFrame, lexicon: DataFrame) -> list[tuple]:
    """The reference lists; more than MAX_ENTRIES entries are refused, never cut."""
    field = F.when(F.col("kind") == "role", F.lit("people.role")).otherwise(F.lit("nodes.role_class"))
    a = role_list.where("kind IN ('role', 'role_class')").select(field, "entry", "label", "pt", "short").limit(MAX_ENTRIES + 1).collect()
    b = lexicon.select(F.lit("person_tags.matched"), "id", "label", "pt", F.lit(None).cast("string")).limit(MAX_ENTRIES + 1).collect()
    if len(a) + len(b) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    return sorted((tuple(r) for r in [*a, *b]), key=str)


def canonical_entries(people: DataFrame, nodes: DataFrame, tags: DataFrame, role_list: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(field, rec, value, entry) for every free value; each distinct value is searched once, then joined back.

    Null and blank values and persons without id are left out, repeated rows
    count once, empty tables give no rows. A title that very many persons have
    is split in the join back.
    """
    entries = entries_of(role_list, lexicon)
    rows = as_table(free_values(people, nodes, tags), "free-values")
    values = rows.select("field", "value").distinct()
    forms = as_table(formed(values), "forms")
    learned = learned_wordings(rows, forms, rule_wordings(rows.sparkSession, entries), tags, role_list)
    patterns = lexicon.where("id IS NOT NULL AND pattern IS NOT NULL").select(F.lit("person_tags.matched").alias("field"), F.col("id").alias("entry"), "pattern")
    mapped = as_table(map_values(values, entries, learned, patterns, forms), "mapped-values")
    return salted_join(rows, mapped, ["field", "value"], "inner").select("field", "rec", "value", "entry")
