"""The main body of web pages, without the furniture of their sites.

Boosted trees judge each line by structure: its form, its neighbours and block,
its place, and what is known across pages of the lines that stand on many.
Wordings of furniture label the training pages only, so the trees must find
furniture of any wording, and decoding keeps the decisions free of contradictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.llm.spam import FUNCTION_WORDS
from tidemark.session import as_table

#: Pages whose lines are labelled for training at most, drawn by hash.
MAX_TRAINING = 700
#: A line counts as common if it stands on this share of all pages (and on LEAST pages at least), so there
#: can't be more common lines than a page's mean number of lines / COMMON, whatever the corpus' size.
COMMON, LEAST = 0.0005, 3

#: Wordings of site furniture in both languages (fixed values), whole lines after folding of digits to '#'.
#: They label the lines of the training pages; the trees don't see them.
NAVIGATION = (
    "podcasts menu search technology programme tickets pt en speakers about what's on home shop contact latest subscribe news partners videos opinion business archive log in "
    "início loja programa pesquisar arquivo vídeos últimas bilhetes notícias contactos parceiros sobre nós economia oradores tecnologia agenda cultural opinião entrar assinar tickets"
)
NAV_WORDS = frozenset(NAVIGATION.split())
FURNITURE = re.compile(
    r"""(?:
    complaints|privacy\ policy|back\ to\ top|follow\ us\ on\ social\ media|masthead|terms\ and\ conditions|accept\ (?:and\ close|all)|manage\ choices|reject|only\ necessary
    |we\ value\ your\ privacy\..*|we\ use\ cookies\b.*|we\ and\ our\ .*partners\b.*|this\ website\ sets\b.*cookies.*|no\ part\ of\ this\ website\b.*|©.*|built\ in\ .+
    |comments?(?:\ \(\#\))?|listen\ to\ this\ story|share|copy\ link|print|save\ article|\#\ min\ read|support\ independent\ reporting.*|story\ continues\ below|your\ e-mail|advertisement|sign\ up|get\ our\ newsletter.*
    |rejeitar|gerir\ preferências|só\ os\ necessários|aceitar\ (?:e\ fechar|tudo)|valorizamos\ a\ sua\ privacidade.*|este\ (?:site|sítio)\ utiliza\ cookies.*|usamos\ cookies\b.*|nós\ e\ os\ nossos\ .*parceiros.*
    |coment(?:ar|ários?)(?:\ \(\#\))?|copiar\ ligação|partilhar|imprimir|guardar\ artigo|ouvir\ este\ artigo|\#\ min\ de\ leitura|continue\ a\ ler\ depois\ do\ anúncio|o\ seu\ e-mail|publicidade|subscrever|receba\ a\ nossa\ newsletter.*|apoie\ o\ jornalismo.*
    |livro\ de\ reclamações|termos\ e\ condições|voltar\ ao\ topo|ficha\ técnica|siga-nos\ nas\ redes\ sociais|política\ de\ privacidade|a\ reprodução\ total\ ou\ parcial\b.*|desenvolvido\ em\ .+
    |.+\ (?:é\ uma\ publicação\ registada|is\ a\ registered\ publication)\ .*
    )""",
    re.I | re.X,
)
RELATED = re.compile(r"(?:mais lidas|leia também|artigos relacionados|ver também|recomendado para si|most read|read also|related stories|recommended for you|see also):?", re.I)
COMMENTS = re.compile(r"comments|comentários", re.I)
REPLY = re.compile(r"[^\W\d_]+(?: [^\W\d_]+){1,3}: \S.*")
BYLINE = re.compile(r"(?:[Pp]or|[Bb]y|[Tt]exto:?|[Tt]ext:?) (?:[A-ZÀ-Ý]\S*)(?: (?:d[aeo]s? )?[A-ZÀ-Ý]\S*){0,4}")
MONTH = r"(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december)"
DATED = re.compile(rf"(?:.*[·,|–-] ?)?(?:#|\d+) (?:de )?{MONTH} (?:de )?(?:#|\d+)(?:[,·| ]*(?:#|\d+)[:h](?:#|\d+))?", re.I)
FAILED = re.compile(r"(?:\# )?not found|page not found|(?:ocorreu um problema ao abrir a página|ocorreu um erro|algo correu mal)\.?|voltar|error \#|página não encontrada|internal server error|access denied|bad gateway|service unavailable", re.I)
SITE_TITLE = re.compile(r".+ [—–|·-] (?:speakers|agenda|record|press|programme|oradores|programa|arquivo|imprensa|notícias)", re.I)
TRAIL = re.compile(r" [›>] ")
HOUSE = re.compile(r"© # (.+?)\. (?:all rights|todos os)|(?:^|[—|·] )(.+?) (?:é uma publicação registada|is a registered publication)", re.I)
TIME = re.compile(r"\d{1,2}[:h]\d{2}\b")
ENDED = re.compile(r"[.!?…»\"”)]$")
DIGITS = re.compile(r"\d+")
JOINERS = re.compile(r" [›>·|/—–] ")
WORD = re.compile(r"[^\W\d_]+")


def fold(line: str) -> str:
    """The line as it is compared across pages: blanks collapsed, digits as '#'."""
    return DIGITS.sub("#", " ".join(line.split()))


def nav_only(line: str) -> bool:
    """Whether a line holds words of navigation only."""
    words = WORD.findall(line.lower())
    return len(words) > 0 and all(w in NAV_WORDS or w in ("what", "s") for w in words)


def house(lines: list[str], publisher: str | None) -> str:
    """The name of the house: the publisher without addition, else what its copyright line says."""
    if publisher:
        return " ".join(publisher.split("(")[0].split())
    return next((m.group(1) or m.group(2) for x in lines if (m := HOUSE.search(x))), "")


def furniture_like(line: str, publisher: str) -> bool:
    """Whether a folded line reads as furniture by itself."""
    if FURNITURE.fullmatch(line) or RELATED.fullmatch(line) or COMMENTS.fullmatch(line) or BYLINE.fullmatch(line) or DATED.fullmatch(line) or FAILED.fullmatch(line):
        return True
    if publisher and (line == publisher or line.startswith((publisher + " —", publisher + " ·", publisher + " |"))):
        return True
    head, colon, rest = line.partition(": ")
    if colon and rest and RELATED.fullmatch(head):
        return True
    parts = [p for p in JOINERS.split(line)]
    if len(parts) > 1 and sum(bool(FURNITURE.fullmatch(p)) for p in parts) >= 0.5 * len(parts):
        return True
    if nav_only(line) and not line.endswith(".") or SITE_TITLE.fullmatch(line):
        return True
    # a trail of navigation that ends in the headline
    trail = TRAIL.split(line)
    return len(trail) >= 2 and all(nav_only(p) for p in trail[:-1])


def page_lines(frozen: str) -> tuple[list[int], list[str]]:
    """Positions and folded texts of the non-blank lines."""
    pos, folded = [], []
    for i, raw in enumerate(frozen.split("\n")):
        f = fold(raw)
        if f:
            pos.append(i)
            folded.append(f)
    return pos, folded


SIGNED = re.compile(r"© # ([^.|—]+)")
#: What a line is by itself.
LINE = ["chars", "words", "function", "ended", "dash", "bullet", "time", "quote", "digits", "capital", "joiners", "colon", "trail", "sign", "first_upper", "long"]
#: What is known of a common line from all pages: how many hold it, where it stands, and what stands around it.
KNOWN = ["share", "place", "prev_long", "next_long", "next_words", "next_ended", "after_common"]
CONTEXT = [
    "own_house", "index", "to_end", "before_long", "after_long", "long_above", "long_below", "n_lines", "page_long", "block_size", "block_common", "block_words", "block_ended", "blank_before", "near_common", "near_long", "near_ended",
    "above_distance", "above_longs", "above_open", "below_distance", "below_place", "common_run",
]
NEAR = [f"{side}_{name}" for side in ("prev", "next", "prev2", "next2") for name in ("words", "ended", "function", "share", "long", "colon", "capital")]
NAMES = [*LINE, *KNOWN, *CONTEXT, *[f"above_{k}" for k in KNOWN], *NEAR]
AT = {name: i for i, name in enumerate(NAMES)}


@lru_cache(100_000)
def line_features(line: str) -> tuple[float, ...]:
    """Form of one folded line, see LINE."""
    words = WORD.findall(line)
    k = len(words)
    fw = sum(w.lower() in FUNCTION_WORDS for w in words)
    ended = ENDED.search(line) is not None
    return (
        float(min(len(line), 2000)), float(k), fw / max(k, 1), float(ended), float(" — " in line or " – " in line), float(line[0] in "-*•–"), float(TIME.match(line.replace("#:#", "1:11")) is not None), float(line[0] in "«\"“'"),
        float(line.count("#")), sum(w[0].isupper() for w in words) / max(1, k), float(len(JOINERS.findall(line))), float(": " in line), float(len(TRAIL.findall(line))), float(sum(map(line.count, "©€→"))), float(line[0].isupper()),
        float(k >= 9 and ended and fw >= 0.12 * k),
    )


def line_hash(line: str) -> int:
    """The hash a line is known by, the same as Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def neutral(line: str, name: str) -> str:
    """The line with the name of its house as '@', so that lines of all houses can be compared."""
    return line.replace(name, "@") if name else line


class Pages:
    """The lines of many pages, one after the other, with their form; everything else is counted over these arrays."""

    def __init__(self, pages: list[tuple[str | None, str | None]]):
        self.pos, self.lines, size = [], [], []
        houses = []
        for text, publisher in pages:
            pos, lines = page_lines(text) if text else ([], [])
            name = " ".join(publisher.split("(")[0].split()) if publisher else next((m.group(1).strip() for x in lines if (m := SIGNED.search(x))), "")
            houses += [bool(name) and name in x for x in lines]
            self.pos += pos
            self.lines += [neutral(x, name) for x in lines]
            size.append(len(lines))
        self.size = np.array(size, int)
        self.n = len(self.lines)
        self.page = np.repeat(np.arange(len(size)), self.size)
        self.start = np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.index = np.arange(self.n) - self.start
        self.form = np.array([line_features(x) for x in self.lines]).reshape(self.n, len(LINE))
        self.house = np.array(houses, float)

    def shift(self, v: np.ndarray, d: int, fill: float) -> np.ndarray:
        """The value d lines further on the same page."""
        out = np.full(self.n, fill)
        at = np.arange(self.n) + d
        ok = (at >= 0) & (at < self.n)
        ok[ok] = self.page[at[ok]] == self.page[ok]
        out[ok] = v[at[ok]]
        return out

    def around(self) -> np.ndarray:
        """What KNOWN averages for a line, without its share: place, and the lines before and after."""
        long, words, ended = (self.form[:, LINE.index(k)] for k in ("long", "words", "ended"))
        place = self.index / np.maximum(1, self.size[self.page] - 1)
        return np.stack([place, self.shift(long, -1, 0), self.shift(long, 1, 0), np.minimum(self.shift(words, 1, 0), 30), self.shift(ended, 1, 0)], 1)

    def features(self, known: dict[int, tuple[float, ...]]) -> np.ndarray:
        """NAMES of every line."""
        if not self.n:
            return np.zeros((0, len(NAMES)))
        nothing = (0.0,) * (len(KNOWN) - 1)
        stats = np.array([known.get(line_hash(x), nothing) for x in self.lines])
        common = (stats[:, 0] > 0).astype(float)
        stats = np.concatenate([stats, self.shift(common, -1, 1)[:, None]], 1)
        f = {k: self.form[:, i] for i, k in enumerate(LINE)}
        f["share"] = stats[:, 0]
        n, count = self.size[self.page], len(self.size)
        at = np.arange(self.n)
        total = lambda v: np.bincount(self.page, v, count)[self.page]
        before = lambda v: np.cumsum(v) - v - (np.cumsum(v) - v)[self.start]
        long, all_long = f["long"], total(f["long"])
        above = before(long)
        gap = np.diff(np.array(self.pos), prepend=0) > 1
        new = (self.index == 0) | gap
        block = np.cumsum(new) - 1
        size = np.bincount(block)
        mean = lambda v: (np.bincount(block, v) / size)[block]
        win = lambda v: sum(self.shift(v, d, 0) for d in range(-3, 4)) / 7
        # the last common line above, and the next below, on the same page
        mark = np.where(common > 0, at, -1)
        last = np.concatenate([[-1], np.maximum.accumulate(mark)[:-1]])
        has = last >= self.start
        last = np.where(has, last, 0)
        following = np.where(common > 0, at, self.n)
        nxt = np.concatenate([np.minimum.accumulate(following[::-1])[::-1][1:], [self.n]])
        has_next = nxt < self.start + n
        nxt = np.where(has_next, nxt, 0)
        c_long, c_open = np.cumsum(long), np.cumsum(1 - f["ended"])
        run = at - np.maximum.accumulate(np.where((common == 0) | (self.index == 0), at, 0))
        context = [
            self.house, np.minimum(self.index, 60), np.minimum(n - 1 - self.index, 60), above == 0, above + long == all_long, np.minimum(above, 30), np.minimum(all_long - above - long, 30), np.minimum(n, 300), all_long / n, size[block], mean(common), mean(f["words"]), mean(f["ended"]), new,
            win(common), win(long), win(f["ended"]), np.where(has, np.minimum(at - last, 40), 41), np.where(has, c_long - c_long[last], 40), np.where(has, c_open - c_open[last], 40), np.where(has_next, np.minimum(nxt - at, 40), 41), np.where(has_next, stats[nxt, 1], 1.0), np.minimum(run, 20),
        ]
        near = [self.shift(f[k], d, 0) for d in (-1, 1, -2, 2) for k in ("words", "ended", "function", "share", "long", "colon", "capital")]
        return np.concatenate([self.form, stats, np.stack([np.asarray(c, float) for c in context], 1), np.where(has[:, None], stats[last], 0.0), np.stack(near, 1)], 1)


def weak_labels(lines: list[str], publisher: str | None) -> np.ndarray:
    """1 for body, 0 for furniture, by wordings: furniture, related stories and comments below their headings.

    A page without any sentence or list line has no body.
    """
    n, pub = len(lines), house(lines, publisher)
    words = [WORD.findall(x) for x in lines]
    fur = [furniture_like(x, pub) for x in lines]
    long = [len(w) >= 9 and ENDED.search(x) is not None and sum(y.lower() in FUNCTION_WORDS for y in w) >= 0.12 * len(w) and not f for x, w, f in zip(lines, words, fur)]
    out, mode = np.zeros(n), ""
    for i, x in enumerate(lines):
        if RELATED.fullmatch(x):
            mode = "r"
        elif COMMENTS.fullmatch(x):
            mode = "c"
        elif mode == "r" and (fur[i] or long[i] or x.endswith(".") or x.startswith("- ") or (len(words[i]) <= 6 and i + 1 < n and long[i + 1])):
            mode = ""  # related headlines have no full stop, no bullet, and no paragraph below them
        elif mode == "c" and (fur[i] or not REPLY.fullmatch(x)):
            mode = ""
        out[i] = not fur[i] and not mode
    told = any(out[i] and (len(words[i]) >= 5 or TIME.match(x.replace("#:#", "1:11"))) for i, x in enumerate(lines))
    return out if told and not all(map(FAILED.fullmatch, lines)) else np.zeros(n)


def decode(log_odds: np.ndarray, x: np.ndarray, switch: float = 0.35, opening: float = 1.0) -> np.ndarray:
    """Labels of the lines of a page that don't contradict its tree: page, zones, lines.

    A zone is what lies between two common lines that paragraphs don't follow,
    together with the line it begins with (a heading of related stories or
    comments, or any other furniture). From the leaves up: the best labelling
    of a zone's lines (dynamic programming, `switch` for each change inside)
    competes with 'all furniture', and the page's best zones with 'no body'. A
    node decided as furniture leaves no body below it, and a body line needs its
    zone and page to be open; the page costs `opening`.
    """
    n = len(log_odds)
    out = np.zeros(n, bool)
    if not n:
        return out
    heading = (x[:, AT["share"]] > 0) & (x[:, AT["next_long"]] < 0.5)
    starts = [0] + [i for i in range(1, n) if heading[i]] + [n]
    total = 0.0
    for a, b in zip(starts, starts[1:]):
        # gain of body over furniture for each line; states 0 furniture, 1 body
        back = np.zeros((b - a, 2), int)
        score = [0.0, 0.0]
        for i in range(a, b):
            stay0, from1 = score[0], score[1] - switch
            stay1, from0 = score[1], score[0] - switch
            back[i - a] = (int(from1 > stay0), int(stay1 >= from0))
            score = [max(stay0, from1), max(stay1, from0) + float(log_odds[i])]
        if max(score) <= 0:
            continue
        total += max(score)
        state = int(score[1] > score[0])
        for i in range(b - 1, a - 1, -1):
            out[i] = state == 1
            state = back[i - a][state]
    return out if total > opening else np.zeros(n, bool)


def common_lines(pages: DataFrame, text: str, publisher: str) -> dict[int, tuple[float, ...]]:
    """KNOWN of each common line by its hash. Lines move as hashes and sums; the result is bounded by COMMON."""
    cols = KNOWN[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [(t, p) for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and not t.isspace()]
            made = Pages(given)
            first = np.zeros(made.n, bool)
            seen: set = set()
            for i, key in enumerate(zip(made.page.tolist(), made.lines)):
                if key not in seen:
                    seen.add(key)
                    first[i] = True
            kept = np.flatnonzero(first)
            hashes = [line_hash(made.lines[i]) for i in kept] + [0] * len(given)  # one row of hash 0 counts each page
            values = np.concatenate([made.around()[kept], np.zeros((len(given), len(cols)))]) if made.n else np.zeros((len(given), len(cols)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *[pa.array(values[:, i]) for i in range(len(cols))]], ["h", *cols])

    rows = pages.select(text, publisher).mapInArrow(run, "h long, " + ", ".join(f"{c} double" for c in cols))
    counted = rows.groupBy("h").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])
    counted = as_table(counted.where(F.col("n") >= LEAST), "lines")  # a line on fewer pages is never common
    total = next((r.n for r in counted.where("h = 0").collect()), 0)
    least = max(LEAST, COMMON * total)
    return {r.h: (r.n / total, *[r[c] for c in cols]) for r in counted.where((F.col("n") >= least) & (F.col("h") != 0)).toLocalIterator()}


def fit(pages: DataFrame, key: str, text: str, publisher: str, known: dict[int, tuple[float, ...]], limit: int = MAX_TRAINING) -> trees.Boosted | None:
    """Boosted trees on the weakly labelled lines of at most `limit` pages, drawn by hash.

    A page whose common lines the wordings mostly don't know is of a site they
    can't label, and isn't learned from.
    """
    rows = pages.where(F.length(F.trim(text)) > 0).select(key, text, publisher).orderBy(F.xxhash64(key, text), key).limit(limit).collect()
    made = Pages([(r[1], r[2]) for r in rows])
    if not made.n:
        return None
    x, y = made.features(known), np.concatenate([weak_labels(page_lines(r[1])[1], r[2]) for r in rows])
    common = (x[:, AT["share"]] > 0).astype(float)
    told = np.bincount(made.page, common * (y == 0), len(rows)) >= 0.5 * np.bincount(made.page, common, len(rows))
    use = told[made.page] if told.any() else np.ones(made.n, bool)
    return trees.boost(x[use], y[use], rounds=90, depth=5)


def main_body(pages: DataFrame, key: str = "id", text: str = "frozen", publisher: str = "publisher") -> DataFrame:
    """(key, line_no, score), distinct: the lines of the main body of each page, line_no from 0 at '\\n'.

    Null, empty and error pages and pages without a piece give no rows; blank
    lines are never body; repeated pages give their rows once; a null publisher
    costs its feature only; extra columns are ignored. Pages are decided whole
    in the task that reads them; only counts of lines are shuffled.
    """
    spark = pages.sparkSession
    known = common_lines(pages, text, publisher)
    model = fit(pages, key, text, publisher, known)
    shipped = spark.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, trained = shipped.value
        for b in batches:
            if trained is None:
                continue
            made = Pages(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
            if not made.n:
                continue
            x = made.features(stats)
            odds = trained.log_odds(x)
            body = np.zeros(made.n, bool)
            end = np.cumsum(made.size)
            for a, z in zip(end - made.size, end):
                body[a:z] = decode(odds[a:z], x[a:z])
            kept = np.flatnonzero(body)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(made.page[kept], pa.int32())), pa.array(np.array(made.pos, np.int32)[kept]), pa.array(odds[kept])], ["_key", "line_no", "score"])

    found = pages.select(key, text, publisher).mapInArrow(run, f"_key {dict(pages.dtypes)[key]}, line_no int, score double")
    return found.groupBy(F.col("_key").alias(key), "line_no").agg(F.max("score").alias("score"))
