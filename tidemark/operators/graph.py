"""The property graph as DataFrames: first delivery wins, degree, neighbourhoods, paths, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import as_table

#: Verbs of the graph: inverse, domain, range, readings in both languages (fixed values).
VERBS = [
    ("speaks_on", "spoken_on_by", "Person", "Topic", "{s} speaks on {o}", "{s} fala sobre {o}", "fala_sobre", "falado_por"),
    ("present_in", "lists", "Person", "Snapshot", "{s} is present in {o}", "{s} está presente em {o}", "presente_em", "lista"),
    ("attested_by", "attests", "Person", "Source", "{s} is attested by {o}", "{s} é atestado por {o}", "atestado_por", "atesta"),
    ("speaks_at", "hosts", "Person", "Event", "{s} speaks at {o}", "{s} fala em {o}", "fala_em", "acolhe"),
    ("listed_under", "lists_person", "Person", "Organisation", "{s} is listed under {o}", "{s} está listado em {o}", "listado_em", "lista_pessoa"),
    ("offers", "offered_by", "Person", "Service", "{s} offers {o}", "{s} oferece {o}", "oferece", "oferecido_por"),
    ("captured_in", "captures", "Source", "Snapshot", "{s} is captured in {o}", "{s} foi capturado em {o}", "capturado_em", "captura"),
    ("absent_from", "lacks", "Person", "Snapshot", "{s} is absent from {o}", "{s} está ausente de {o}", "ausente_de", "nao_contem"),
    ("advocates", "advocated_by", "Person", "Idea", "{s} advocates {o}", "{s} defende {o}", "defende", "defendido_por"),
    ("part_of", "includes", "Session", "Event", "{s} is part of {o}", "{s} faz parte de {o}", "parte_de", "inclui"),
    ("uses", "used_by", "Person", "Technology", "{s} uses {o}", "{s} usa {o}", "usa", "usado_por"),
    ("active_in", "has_active", "Person", "Industry", "{s} is active in {o}", "{s} atua em {o}", "atua_em", "tem_ativo"),
    ("features", "featured_in", "Session", "Person", "{s} features {o}", "{s} conta com {o}", "conta_com", "participa_em"),
    ("on_stage", "stages", "Session", "Stage", "{s} is on {o}", "{s} decorre em {o}", "decorre_em", "recebe"),
]
VERB_SCHEMA = "verb string, inverse string, domain string, range string, reads string, pt_reads string, pt_verb string, pt_inverse string"


def verbs(spark: SparkSession) -> DataFrame:
    """The ontology; a fixed, small table that joins broadcast by themselves."""
    return spark.createDataFrame(VERBS, VERB_SCHEMA)


def first_delivered(df: DataFrame, key: str = "id", at: str = "recorded") -> DataFrame:
    """One row per key, the one recorded first; reduced map-side, no sort of the whole table."""
    rest = [c for c in df.columns if c not in (key, at)]
    return df.groupBy(key).agg(F.min(F.struct(at, *rest)).alias("_r")).select(key, "_r.*")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, verb, out): every edge from both of its ends; a self-loop once."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "verb", F.lit(True).alias("out"))
    back = edges.where("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), "verb", F.lit(False).alias("out"))
    return out.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end, a self-loop once; two equi-joins instead of one join on OR."""
    return both_ways(edges).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("degree"))


def in_out_degree(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree); here a self-loop counts at both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").where("id IS NOT NULL").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), (F.sum("o") + F.sum("i")).alias("degree"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int, cut: bool = True) -> DataFrame:
    """(id, depth): nodes within `hops` of the start nodes, with the least depth.

    A frontier loop: each round joins only the nodes reached last, in either
    direction, and leaves out those known. The frontier is written to the
    shared folder so plans don't grow with the rounds.
    """
    steps = both_ways(edges).select("id", "other").where("id IS NOT NULL AND other IS NOT NULL").distinct()
    if cut and hops > 2:
        steps = as_table(steps, "steps")
    known = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = known
    for depth in range(1, hops + 1):
        reached = frontier.join(steps, "id").select(F.col("other").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        frontier = reached.withColumn("depth", F.lit(depth))
        if cut and hops > 2:
            frontier = as_table(frontier, "frontier")
        known = known.unionByName(frontier)
    return known


def distance(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(start, end, length): length of the shortest undirected path; null if there is none (or, with `most`, none of so few steps)."""
    spark = edges.sparkSession
    steps = as_table(both_ways(edges).select("id", "other").where("id IS NOT NULL AND other IS NOT NULL").distinct(), "steps")
    known = spark.createDataFrame([(start,)], "id string")
    frontier, found, k = known, 0 if start == end else None, 0
    while found is None and (most is None or k < most):
        k += 1
        frontier = as_table(frontier.join(steps, "id").select(F.col("other").alias("id")).distinct().join(known, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        if frontier.where(F.col("id") == end).limit(1).count():
            found = k
        known = known.unionByName(frontier)
        if k % 16 == 0:  # else the plan grows with the length
            known = as_table(known, "known")
    return spark.createDataFrame([(start, end, found)], "start string, end string, length int")


def exactly_two_hops(edges: DataFrame, start: Column) -> DataFrame:
    """(id): ends of walks of exactly two edges in any direction from nodes that satisfy `start` (over column id)."""
    steps = both_ways(edges).select("id", "other")
    first = steps.where(start).select(F.col("other").alias("id"))
    return first.join(steps, "id").select(F.col("other").alias("id")).distinct()


def path_pattern(edges: DataFrame, nodes: DataFrame, start: Column, steps: list[tuple[str | None, str, Column | None]], cap: int | None = None) -> DataFrame:
    """(n0, v1, n1, ...): simple paths by pattern; a step is (verb or any, 'out' | 'in' | 'both', filter of the node reached).

    One join per step, filters before each join; a node is never met twice. A
    `cap` is a feature of the report: cap + 1 rows tell that there were more.
    """
    moves = both_ways(edges).where("id IS NOT NULL AND other IS NOT NULL")
    rows = nodes.where(start).select(F.col("id").alias("n0"))
    for k, (verb, way, keep) in enumerate(steps, 1):
        m = moves if verb is None else moves.where(F.col("verb") == verb)
        m = m if way == "both" else m.where(F.col("out") == (way == "out"))
        if keep is not None:
            m = m.join(nodes.where(keep).select(F.col("id").alias("other")), "other", "left_semi")
        m = m.select(F.col("id").alias(f"n{k - 1}"), F.col("verb").alias(f"v{k}"), F.col("other").alias(f"n{k}"), F.col("out").alias(f"out{k}"))
        rows = rows.join(m, f"n{k - 1}")
        for j in range(k):
            rows = rows.where(F.col(f"n{j}") != F.col(f"n{k}"))
    return rows.orderBy(*rows.columns).limit(cap + 1) if cap else rows


def collapse(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(source, verb, target) with the member nodes as one node; inner edges go, parallel ones merge."""
    m = members.select("id").distinct()
    marked = edges.join(m.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(m.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return (
        marked.where("NOT (coalesce(_s, false) AND coalesce(_t, false))")
        .select(F.when(F.col("_s"), F.lit(group)).otherwise(F.col("source")).alias("source"), "verb", F.when(F.col("_t"), F.lit(group)).otherwise(F.col("target")).alias("target"))
        .distinct()
    )


TRIPLE = ["s", "p", "o_value", "o_kind", "o_lang", "o_datatype"]
#: Node attributes that become literal triples.
PROPERTIES = ["source", "role", "role_class", "org", "day", "time", "kind", "publisher", "published", "date", "url", "page"]


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TRIPLE rows: types, labels, attributes, the typed flag, edges and the ontology.

    One pass over the nodes emits all of a node's triples; nulls give none.
    """
    t = lambda p, v, kind, lang=None, kind_of=None: F.struct(F.lit(p).alias("p"), v.cast("string").alias("o_value"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"), F.lit(kind_of).cast("string").alias("o_datatype"))
    parts = [t("rdf:type", F.col("type"), "iri"), t("rdfs:label", F.col("label"), "literal")]
    parts += [t(p, F.col(p), "literal") for p in PROPERTIES]
    parts.append(t("no_longer_listed", F.when(F.col("no_longer_listed") == 1, F.lit("true")).when(F.col("no_longer_listed") == 0, F.lit("false")), "literal", None, "xsd:boolean"))
    of_nodes = nodes.select(F.col("id").alias("s"), F.inline(F.array(*parts))).where("o_value IS NOT NULL")
    of_edges = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("s"), F.col("verb").alias("p"), F.col("target").alias("o_value"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype"))
    return of_nodes.unionByName(of_edges).unionByName(ontology_triples(nodes.sparkSession))


def ontology_triples(spark: SparkSession) -> DataFrame:
    rows = []
    for verb, inverse, _, _, _, _, pt, pt_inverse in VERBS:
        rows.append((inverse, "owl:inverseOf", verb, "iri", None, None))
        for s, en, other in ((verb, verb, pt), (inverse, inverse, pt_inverse)):
            rows += [(s, "rdfs:label", en.replace("_", " "), "literal", "en", None), (s, "rdfs:label", other.replace("_", " "), "literal", "pt", None)]
    return spark.createDataFrame(rows, "s string, p string, o_value string, o_kind string, o_lang string, o_datatype string")


def pattern(triples_: DataFrame, p: str, s: str, o: str) -> DataFrame:
    """A basic graph pattern: (s, o) of predicate p under the names of its variables."""
    return triples_.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o_value").alias(o))


def n_triples(triples_: DataFrame, base: str) -> DataFrame:
    """(value): one N-Triples line per triple, with literals escaped."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, "[ <>\"{}|^`]", "_"), F.lit(">"))
    esc = F.col("o_value")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), esc, F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^"), "o_datatype"), F.lit("")))
    return triples_.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o_kind") == "iri", iri(F.col("o_value"))).otherwise(literal), F.lit(".")).alias("value"))


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o_value, o_kind, o_lang, o_datatype) of N-Triples files, line by line; broken lines are left out."""
    line = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^(\S+))?) \.\s*$'
    x = spark.read.text(path).where(F.col("value").rlike(line))
    g = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    text = F.regexp_extract("value", line, 4)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return x.select(g(1).alias("s"), g(2).alias("p"), F.coalesce(g(3), text).alias("o_value"), F.when(g(3).isNotNull(), "iri").otherwise("literal").alias("o_kind"), g(5).alias("o_lang"), g(6).alias("o_datatype"))


class View:
    """What a reader of the graph asks for: a node, edges, a part of the graph, a search, the neighbours."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def get_node(self, ident: str) -> DataFrame:
        return self.nodes.where(F.col("id") == ident)

    def get_edges(self, ident: str | None = None, verb: str | None = None, target: str | None = None) -> DataFrame:
        """Edges at either end of a node, of a verb, to a target; all of them without conditions."""
        out = self.edges
        if ident is not None:
            out = out.where((F.col("source") == ident) | (F.col("target") == ident))
        if verb is not None:
            out = out.where(F.col("verb") == verb)
        return out if target is None else out.where(F.col("target") == target)

    def get_graph(self, type: str | None = None, pack: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The nodes of a type and pack, and the edges between them."""
        n = self.nodes
        n = n if type is None else n.where(F.col("type") == type)
        n = n if pack is None else n.where(F.col("pack") == pack)
        e = self.edges
        for end in ("source", "target"):
            e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
        return n, e

    def search(self, text: str) -> DataFrame:
        """Nodes with the text in label, role or organisation, whatever the case."""
        return self.nodes.where(F.contains(F.lower(F.concat_ws(" ", "label", "role", "org")), F.lit(text.lower())))

    def explore(self, ident: str) -> DataFrame:
        """(id, label, type, verb) of the neighbours of a node."""
        near = both_ways(self.edges).where(F.col("id") == ident).select(F.col("other").alias("id"), "verb")
        return near.join(self.nodes.select("id", "label", "type"), "id").select("id", "label", "type", "verb")
