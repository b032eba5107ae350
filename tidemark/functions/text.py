"""Text functions: visible text, slugs, keys, masks, classifiers; built-in functions wherever they suffice."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _series(f, kind):
    """An Arrow-batched function of one text column; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


nfc = _series(lambda x: unicodedata.normalize("NFC", x), T.StringType())
nfkd = _series(lambda x: unicodedata.normalize("NFKD", x), T.StringType())
unescape = _series(html.unescape, T.StringType())
without_marks = _series(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), T.StringType())


def collapse(c: Column) -> Column:
    """Runs of any white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def escaped(c: Column) -> Column:
    """Text as it stands in HTML or XML: '&', '<' and '>' as entities."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def visible(page: Column, entities: bool = True) -> Column:
    """Text of a page: scripts, styles and drawings go, tags become spaces, entities are read after the tags are gone."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style|svg)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return collapse(unescape(bare) if entities else bare)


def stripped(fragment: Column) -> Column:
    """Tags become nothing, entities are read, a literal \\n is a space."""
    return F.trim(F.replace(unescape(F.regexp_replace(fragment, r"(?s)<[^>]*>", "")), F.lit("\\n"), F.lit(" ")))


def slug(c: Column, empty: str = "sem-nome") -> Column:
    """Identifier: compatibility letters without marks, others dropped, runs of the rest as '-'."""
    ascii_only = F.regexp_replace(nfkd(c), r"[^\x00-\x7F]", "")
    s = F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(empty)).otherwise(s)


def raw_slug(c: Column, empty: str = "unnamed") -> Column:
    """The older identifier: accented letters become '-' like other signs."""
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(empty)).otherwise(s)


def content_key(c: Column) -> Column:
    """16 hex digits of the hash of the normalised text."""
    return F.substring(F.sha2(collapse(nfc(c)), 256), 1, 16)


def level(c: Column) -> Column:
    """Excerpt form: NFC, dashes, quotes and blanks levelled, no blank before punctuation, lower case; accents stay."""
    t = F.translate(nfc(c), " ‐‑‒–—−‘’“”«»­", " ------''\"\"\"\"")
    t = F.regexp_replace(F.regexp_replace(collapse(t), r" ([.,;:!?%)\]])", "$1"), r"([(\[]) ", "$1")
    return F.lower(t)


def domain(url: Column) -> Column:
    """Host and port of an address without scheme and 'www.', lower case."""
    bare = F.regexp_replace(F.lower(url), "^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), r"^www\.", "")


def words(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def clipped(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


#: Months and weekdays of both languages, masked as '@' (fixed values).
MONTHS_DAYS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december|segunda-feira|terça-feira|quarta-feira|quinta-feira|sexta-feira|sábado|domingo|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
#: One of them as a word of its own; a digit beside it ends the word, too.
MONTH_DAY = rf"(?<![\p{{L}}\p{{M}}_])(?:{MONTHS_DAYS})(?![\p{{L}}\p{{M}}_])"


def mask(c: Column) -> Column:
    """Template of a text: digit runs are '#', months and weekdays '@'."""
    return F.regexp_replace(F.regexp_replace(c, f"(?iu){MONTH_DAY}", "@"), "[0-9]+", "#")


def masked_values(c: Column) -> Column:
    """What stands at each '#' and '@' of mask(), in order; a '#' or '@' of the text itself stands for itself."""
    return F.regexp_extract_all(c, F.lit(f"(?iu)[#@]|[0-9]+|{MONTH_DAY}"), F.lit(0))


def fill(template: Column, values: Column) -> Column:
    """The inverse of mask(): the k-th placeholder gets the k-th value."""
    parts = F.split(template, "[#@]")
    each = F.zip_with(F.slice(values, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts)), lambda v, p: F.concat(F.coalesce(v, F.lit("")), F.coalesce(p, F.lit(""))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(each, ""))


#: Evidence of Portuguese: letters English hardly has, and function words (fixed values).
PORTUGUESE = r"(?iU)[ãõçáéíóúâêô]|\b(?:que|não|para|uma|dos|das|pela|pelo|são|está|mais|como)\b"
FUNCTION_WORDS = r"(?iU)\b(?:que|não|para|uma|um|dos|das|com|pela|pelo|são|está|mas|como|quando|porque|este|esta)\b"


def looks_portuguese(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PORTUGUESE)) >= 2


def comment_is_portuguese(c: Column) -> Column:
    """Two different function words after code spans and «quotes» are gone."""
    bare = F.regexp_replace(F.regexp_replace(c, "`[^`]*`", " "), "«[^»]*»", " ")
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(FUNCTION_WORDS), F.lit(0)), F.lower))) >= 2


def machine_fact(c: Column) -> Column:
    """Hashes, addresses, paths, versions, bare numbers and dates."""
    return F.trim(c).rlike(r"(?i)^(?:[0-9a-f]{12,64}|https?://\S+|[\w./-]+\.(?:json|py|js|md|html|snapshot)|v?\d+(?:\.\d+)+|[\d\s.,:%/+-]+|\d{4}-\d{2}-\d{2}(?:T\S*)?)$")


def translatable(c: Column) -> Column:
    """Long enough, of several words, no machine fact and with evidence of Portuguese."""
    return (F.length(c) >= 12) & (words(c) >= 2) & ~machine_fact(c) & ~c.rlike(r"\$\{|\{\{") & looks_portuguese(c)


def generated(c: Column) -> Column:
    """Made by a program: dates, versions, counted nouns or more than 12 % digits."""
    digits = F.regexp_count(c, F.lit(r"\d")) / F.greatest(F.length(c), F.lit(1))
    return (digits > 0.12) | c.rlike(rf"(?iU)\b\d+ (?:de )?(?:{MONTHS_DAYS})\b|\bv\d+\.\d+|\b\d+ (?:páginas|nomes|pages|names|candidaturas|applications)\b")


def first_match(c: Column, pattern: Column | str, most: int = 40) -> Column:
    """The first match cut to `most` letters; null where there is none (an empty match is no null)."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.regexp_like(c, p), F.substring(F.regexp_substr(c, p), 1, most))


def locate_excerpt(excerpt: str | None, text: str | None, least: int = 30, most: int = 3) -> tuple[str | None, int]:
    """('exacta', 1), ('fragmentada', n) or (None, n) for levelled texts.

    An excerpt that doesn't stand in the text as it is may be put together from
    the fewest pieces that stand there one behind the other, each of `least`
    letters and `most` of them; blanks between pieces don't count. n is then
    their number, or how many could be placed. A piece begins with `least`
    letters, so the text is indexed once by the runs of so many letters; it is
    ended where the text ends it, or up to `least` letters before, so that the
    next one can be long enough.
    """
    if not excerpt or not text:
        return None, 0
    if excerpt in text:
        return "exacta", 1
    places: dict[str, list[int]] = {}
    for p in range(len(text) - least + 1):
        places.setdefault(text[p : p + least], []).append(p)

    def common(i: int, p: int) -> int:
        """How many letters from `excerpt[i]` and `text[p]` on are the same; `least` are."""
        k, step = least, least
        while step:
            if excerpt[i + k : i + k + step] == text[p + k : p + k + step] and i + k + step <= len(excerpt) and p + k + step <= len(text):
                k, step = k + step, step * 2
            else:
                step //= 2
        return k

    end = len(excerpt.rstrip())
    blank = lambda i: i + len(excerpt[i:]) - len(excerpt[i:].lstrip())
    reached = {blank(0): 0}  # letters placed so far, and the earliest place behind them
    for n in range(1, most + 1):
        further: dict[int, int] = {}
        for i, behind in reached.items():
            found = places.get(excerpt[i : i + least], [])
            for p in found[bisect_left(found, behind) :]:
                top = common(i, p)
                for k in range(max(least, top - least), top + 1):
                    if i + k >= end:
                        return "fragmentada", n
                    j = blank(i + k)
                    further[j] = min(further.get(j, len(text)), p + k)
        if not further:
            return None, n - 1
        reached = further
    return None, most


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("pieces", T.IntegerType())]))
def located(excerpt: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate_excerpt(e, t) for e, t in zip(excerpt, text)], columns=["kind", "pieces"])


def entity_linker(names: dict[str, str]) -> Callable[[str], list[tuple[str, str, int]]]:
    """A function of a text: (name, target, position) of the first mention of each target.

    Longest names first, outside tags, links, code and scripts. The alternation
    of all names is built once.
    """
    skip = re.compile(r"<(script|style|code|pre|a)\b.*?</\1\s*>|<[^>]*>|`[^`]*`", re.S | re.I)
    any_name = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?!\w)")

    def link(text: str) -> list[tuple[str, str, int]]:
        free, last, out, seen = [], 0, [], set()
        for m in skip.finditer(text):
            free.append((last, m.start()))
            last = m.end()
        free.append((last, len(text)))
        for a, b in free:
            for m in any_name.finditer(text, a, b):
                if (t := names[m.group()]) not in seen:
                    seen.add(t)
                    out.append((m.group(), t, m.start()))
        return out

    return link if names else lambda text: []


def link_entities(text: str, names: dict[str, str]) -> list[tuple[str, str, int]]:
    """entity_linker() for one text."""
    return entity_linker(names)(text)


def rename_quoted(line: Column, names: Column) -> Column:
    """The line with every whole token in double quotes that the map `names` knows replaced; the rest stays."""
    parts = F.transform(F.split(line, '"', -1), lambda x, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(names, x), x)).otherwise(x))
    return F.array_join(parts, '"')


def resolve(folder: Column, link: Column) -> Column:
    """A relative address resolved against a folder: '.' and empty steps fall out, '..' takes the step before away."""
    steps = F.split(F.concat(folder, F.lit("/"), link), "/", -1)
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(steps, none, step), "/")


def relative(folder: Column, target: Column) -> Column:
    """A target as seen from a folder: up to where the two part, then down."""
    a, b = F.split(folder, "/", -1), F.split(target, "/", -1)
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def version(c: Column, separator: str = ".") -> Column:
    """A version of three numbers as a struct that compares number by number."""
    return F.struct(*[F.split_part(c, F.lit(separator), F.lit(i)).cast("int").alias(x) for i, x in ((1, "major"), (2, "minor"), (3, "patch"))])


def follow(doc, pointer: str) -> tuple[str, str | None]:
    """('ok', value) or (reason, None) of a pointer file#key[number].key or file#key[<id>].key into a document."""
    at = doc
    for key, item in re.findall(r"([^.\[\]]+)(?:\[([^\]]*)\])?", pointer.partition("#")[2]):
        if not isinstance(at, dict) or key not in at:
            return f"no key {key}", None
        at = at[key]
        if item:
            ident = item[1:-1] if item[:1] == "<" else None
            known = at if isinstance(at, list) else []
            found = [x for x in known if isinstance(x, dict) and x.get("id") == ident] if ident is not None else known[int(item) : int(item) + 1] if item.isdigit() else []
            if not found:
                return f"no item {ident if ident is not None else item} of {key}", None
            at = found[0]
    if isinstance(at, (dict, list)):
        return f"not a value: {pointer.partition('#')[2]}", None
    return "ok", None if at is None else str(at)


@F.pandas_udf(_strings("reason", "value"))
def point(doc: pd.Series, pointer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([follow(json.loads(d) if d else None, p or "") for d, p in zip(doc, pointer)], columns=["reason", "value"])


#: JSON types by their names in a schema (fixed values).
JSON_TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def errors_of(value, schema: dict, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, keyword) of everything in a value that breaks its schema: type, enum, required, items, lengths, patterns, bounds."""
    kinds = schema.get("type")
    if kinds and not any(isinstance(value, JSON_TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, "type"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if isinstance(value, dict):
        yield from ((f"{path}/{k}", "required") for k in schema.get("required", []) if k not in value)
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                yield from errors_of(v, known[k], f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}/{k}", "additionalProperties"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        for i, v in enumerate(value):
            yield from errors_of(v, schema.get("items", {}), f"{path}/{i}")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield path, "minLength"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            yield path, "maxLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            yield path, "minimum"
        if value > schema.get("maximum", value):
            yield path, "maximum"


def schema_errors(schema: dict) -> Callable[[Column], Column]:
    """A function of a column of JSON documents: array of (path, error); text that doesn't parse breaks '' with 'json'."""

    def of(text: str | None) -> list[tuple[str, str]]:
        try:
            return [] if text is None else list(errors_of(json.loads(text), schema))
        except ValueError:
            return [("", "json")]

    @F.pandas_udf(T.ArrayType(_strings("path", "error")))
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: [{"path": p, "error": e} for p, e in of(x)])

    return run


def walk_strings(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of the strings of a nested value; objects with a checksum and denied keys are left out whole."""
    if isinstance(value, dict):
        if "sha256" in value:
            return
        for k, v in value.items():
            if k not in ("id", "url"):
                yield from walk_strings(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk_strings(v, f"{path}[{i}]")
    elif isinstance(value, str):
        yield path, value


@F.pandas_udf(T.ArrayType(_strings("path", "text")))
def walked(docs: pd.Series) -> pd.Series:
    return docs.map(lambda x: [] if not x else [{"path": p, "text": s} for p, s in walk_strings(json.loads(x))])
