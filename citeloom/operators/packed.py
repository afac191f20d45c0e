"""Several values packed in one field, split into one value per row.

Every separator is an edge choice of a lattice: it cuts or it belongs to a value. Quoted spans are atomic. Expectation-
maximisation over the whole column learns how often each value occurs, how values look (words by their place in a
value, word shapes, number of parts) and how often each kind of separator cuts; Viterbi paths then choose the splits.

The lattice is walked on two levels. Kinds that mostly cut (semicolon, bar, line break, tab, spaced slash) link pieces
of a text: given how often a kind cuts, whether it does at one place only depends on whether the words behind it are
such as begin values or such as go on with them, so that each of these edges is judged once for each distinct piece.
What stands between the chosen cuts may hold separators that often belong to values (comma, "and"); each such chunk is
a small lattice over its candidate values, with an open end for values of any number of parts.

Value frequencies stay distributed and meet the small lattices in a join; only tables of fixed size (hashed word cells,
shapes, parts, separators) are sent to the workers. Chunks are de-duplicated first, so that a text repeated in a third
of all rows is one lattice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field as dc_field
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.runtime import cut

CELLS = 1 << 15  # word statistics are hashed into so many cells per place in a value; bounds what the driver gathers
PLACES = 8  # first part or later part; alone, first, middle or last word in it
STRONG = (";", r"\|", r"\r?\n|\r", r"\t", r"\s//?\s")  # kinds that mostly cut
HARD = "|".join(STRONG)
PRIOR = (50.0, 0.5)  # cuts and others that a kind is met with before the column is read
LISTED = 4  # parts of the values whose frequency is looked up; longer ones are new values
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")  # fixed values: what may follow a name after a second comma
QUOTED = r'"(?:[^"]|"")*"|“[^”]*”|„[^“”]*[“”]'


@dataclass(frozen=True)
class Grammar:
    """Separators of one field: `weak` are regular expressions of separators that values may also contain."""

    weak: tuple[str, ...] = ()
    conjunction: bool = False  # a value may be introduced by "and" or "&"
    names: bool = False  # values are personal names: "Doe, Jane B." and "J. Doe" are counted as one value


COMMA = r"\s*,\s*"
AND = r"\s*,?\s+(?:and|AND|&)\s+"
WOS_FIELDS = {"au": Grammar((AND, COMMA), True, True), "cr": Grammar(), "id": Grammar((COMMA,))}


def _quotes(text: str) -> bool:
    return '"' in text or "“" in text or "„" in text


def _strong_kind(sep: str) -> int:
    """The place in STRONG of a separator that is one of them."""
    return 4 if "/" in sep else 0 if sep == ";" else 1 if sep == "|" else 3 if sep == "\t" else 2


class _Lexer:
    def __init__(self, grammar: Grammar) -> None:
        weak = "|".join(f"(?P<w{i}>{w})" for i, w in enumerate(grammar.weak))
        ends = "|".join(x for x in (HARD, "|".join(grammar.weak)) if x)
        self.sep = re.compile(f"(?P<h>{HARD})" + (f"|{weak}" if weak else ""))
        self.quoted = re.compile(rf"\s*({QUOTED})\s*(?={ends}|$)")
        self.hard = re.compile(f"(?P<h>{HARD})")
        self.names = grammar.names
        self.comma = grammar.weak.index(COMMA) if COMMA in grammar.weak else -1
        self.head = re.compile(r"^(?:and|AND|&)\s+") if grammar.conjunction else None

    def chunks(self, text: str) -> list[tuple[str, int, str]]:
        """(piece, kind of the strong separator before it or -1, text between it and the piece before) of each piece that isn't empty."""
        out, start, kind, gap = [], 0, -1, 0
        seps = self._seps(text) if _quotes(text) else ((m.start(), m) for m in self.hard.finditer(text))
        for at, sep in chain(seps, ((len(text), None),)):
            if sep is not None and sep.group("h") is None:
                continue
            piece = self._tidy(text[start:at])
            if piece:
                end = start + len(text[start:at].rstrip())
                out.append((piece, kind if out else -1, text[gap : end - len(piece)] if out else ""))
                gap = end
            if sep is not None:
                kind = _strong_kind(sep.group("h"))
                start = sep.end()
        return out

    def _tidy(self, chunk: str) -> str:
        chunk = chunk.strip()
        return self.head.sub("", chunk) if self.head else chunk

    def _seps(self, text: str) -> Iterator[tuple[int, re.Match]]:
        if not _quotes(text):
            yield from ((m.start(), m) for m in self.sep.finditer(text))
            return
        at, n = 0, len(text)
        while at <= n:
            q = self.quoted.match(text, at)
            m = self.sep.search(text, q.end() if q else at)
            if m is None:
                return
            yield m.start(), m
            at = max(m.end(), at + 1) if m.end() == m.start() else m.end()

    def pieces(self, chunk: str) -> tuple[list[tuple[int, int]], list[int]]:
        """Spans between weak separators, and the kind of each separator."""
        spans, kinds, start = [], [], 0
        for at, sep in self._seps(chunk):
            spans.append((start, at))
            kinds.append(int(sep.lastgroup[1:]) if sep.lastgroup != "h" else 0)
            start = sep.end()
        spans.append((start, len(chunk)))
        return spans, kinds


def _bare(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] == '"' == value[-1] and re.fullmatch(r'"(?:[^"]|"")*"', value):
        return value[1:-1].replace('""', '"').strip()
    if len(value) > 1 and value[0] in "“„" and value[-1] in "”“":
        return value[1:-1].strip()
    return value


@lru_cache(maxsize=100_000)
def _seen(word: str) -> tuple[int, int]:
    """Cell and shape of a word."""
    return zlib.crc32(word.lower().encode()) % CELLS, _shape(word)


def _shape(word: str) -> int:
    core = word.strip(".,'’-")
    if not core:
        return 0
    if any(c.isdigit() for c in core):
        return 1
    if len(core) == 1:
        return 2 if word.endswith(".") else 3
    if core.isupper():
        return 4 if len(core) < 4 else 5
    return 6 if core[0].isupper() else 7


def _places(parts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(place, cell, shape) of each word."""
    for p, part in enumerate(parts):
        words = part.split() or [""]
        for i, w in enumerate(words):
            role = 0 if len(words) == 1 else 1 if i == 0 else 3 if i == len(words) - 1 else 2
            yield ((4 if p else 0) + role, *_seen(w))


def _key(value: str, lexer: _Lexer) -> str:
    """What values are counted by: the text in lower case, of a name its family name and first initial."""
    if lexer.names:
        spans, kinds = lexer.pieces(value)
        parts = [re.sub(r"[^\w ]+", " ", value[a:b].lower()).split() for a, b in spans]
        if len(parts) == 1 and len(parts[0]) > 1 and all(w.isalpha() for w in parts[0]):
            return f"{parts[0][-1]} {parts[0][0][0]}" if len(parts[0]) < 4 else " ".join(parts[0])
        if len(parts) == 3 and kinds[1] == lexer.comma and " ".join(parts[2]) in SUFFIXES:
            parts, kinds = parts[:2], kinds[:1]
        if len(parts) == 2 and all(parts) and kinds == [lexer.comma]:
            return f"{' '.join(parts[0])} {parts[1][0][0]}"
    return " ".join(value.lower().split())


@dataclass
class Model:
    """What EM has learned of one field, without the value frequencies; its size does not depend on the data."""

    words: dict[tuple[int, int], float] = dc_field(default_factory=dict)
    shapes: dict[tuple[int, int], float] = dc_field(default_factory=dict)
    places: dict[int, float] = dc_field(default_factory=dict)
    parts: dict[int, float] = dc_field(default_factory=dict)
    split: dict[tuple[int, int, int], float] = dc_field(default_factory=dict)
    total: float = 1.0
    novel: float = 0.2  # share of values that were met once: the chance that the next value is new
    strength: float = 20.0
    memo: dict[tuple[int, int, int], float] = dc_field(default_factory=dict, compare=False)  # at most places, cells and shapes allow

    def word(self, place: int, cell: int, shape: int) -> float:
        """Chance of a word at a place, falling back on its chance anywhere and on the shape of the place's words."""
        chance = self.memo.get((place, cell, shape))
        if chance is None:
            chance = self.memo[place, cell, shape] = self._word(place, cell, shape)
        return chance

    def _word(self, place: int, cell: int, shape: int) -> float:
        n = self.places.get(place, 0.0)
        of_shape = sum(self.shapes.get((p, shape), 0.0) for p in range(PLACES)) + 1.0
        anywhere = (sum(self.words.get((p, cell), 0.0) for p in range(PLACES)) + 0.02) / (of_shape + 50.0)
        back = (self.shapes.get((place, shape), 0.0) + 0.25) / (n + 2.0) * min(anywhere, 1.0)
        return (self.words.get((place, cell), 0.0) + self.strength * back) / (n + self.strength)

    def many(self, n: int = LISTED) -> float:
        """Log probability of a value's number of parts; LISTED and more are one."""
        return math.log((self.parts.get(n, 0.0) + 0.05 * self.total / n) / (1.2 * self.total + 1.0))

    def begins(self, part: str) -> float:
        """Log odds that a part begins a value and doesn't go on with one."""
        first, later = list(_places([part])), list(_places(["", part]))[1:]
        return sum(math.log(self.word(*a)) - math.log(self.word(*b)) for a, b in zip(first, later))

    def value(self, parts: list[str], count: float) -> float:
        """Log probability of a value that was met `count` times elsewhere."""
        new = self.many(min(len(parts), LISTED))
        new += sum(math.log(self.word(*w)) for w in _places(parts))
        return math.log((1.0 - self.novel) * max(count, 0.0) / self.total + self.novel * math.exp(max(new, -600.0)))

    def cut_odds(self, context: int, kind: int) -> tuple[float, float]:
        yes, no = self.split.get((context, kind, 1), 0.0), self.split.get((context, kind, 0), 0.0)
        p = (yes + (1.0 if context else 25.0)) / (yes + no + 50.0)
        return math.log(p), math.log(1.0 - p)


@dataclass(frozen=True)
class _Lattice:
    spans: list[tuple[int, int]]
    kinds: list[int]
    edges: list[tuple[int, int]]
    values: list[str]
    whole: list[bool]  # quoted parts


def _lattice(lexer: _Lexer, chunk: str) -> _Lattice:
    spans, kinds = lexer.pieces(chunk)
    whole = [bool(re.fullmatch(QUOTED, chunk[a:b].strip())) for a, b in spans]
    edges = [
        (i, j)
        for i in range(len(spans))
        for j in range(i, min(len(spans), i + LISTED))
        if i == j or not any(whole[i : j + 1])
    ]
    return _Lattice(spans, kinds, edges, [chunk[spans[i][0] : spans[j][1]] for i, j in edges], whole)


def _scores(lat: _Lattice, chunk: str, context: int, counts: list[float], model: Model) -> list[float]:
    out = []
    for (i, j), count in zip(lat.edges, counts):
        s = model.value([_bare(chunk[a:b]) for a, b in lat.spans[i : j + 1]], count)
        s += sum(model.cut_odds(context, k)[1] for k in lat.kinds[i:j])
        out.append(s + (model.cut_odds(context, lat.kinds[j])[0] if j < len(lat.kinds) else 0.0))
    return out


def _long(lat: _Lattice, chunk: str, context: int, model: Model) -> tuple[list[float], list[float], list[float]] | None:
    """Values of more than LISTED parts, as a chain: scores to enter it with the parts i to i + LISTED, to take one more
    part, and to end before part j. Such a value is a new one, whose score adds up over its words."""
    n = len(lat.spans)
    if n <= LISTED:
        return None
    parts = [_bare(chunk[a:b]) for a, b in lat.spans]
    first = [sum(math.log(model.word(*w)) for w in _places([p])) for p in parts]
    later = [sum(math.log(model.word(*w)) for w in list(_places(["", p]))[1:]) for p in parts]
    later = [-math.inf if quoted else x for x, quoted in zip(later, lat.whole)]
    joins, cuts = ([model.cut_odds(context, k)[x] for k in lat.kinds] for x in (1, 0))
    enter = [first[i] + sum(later[i + 1 : i + LISTED + 1]) + sum(joins[i : i + LISTED]) if not lat.whole[i] else -math.inf for i in range(n - LISTED)]
    more = [-math.inf] + [later[j] + joins[j - 1] for j in range(1, n)]
    ending = model.many() + math.log(model.novel)
    end = [-math.inf] + [ending + (cuts[j - 1] if j < n else 0.0) for j in range(1, n + 1)]
    return enter, more, end


def _viterbi(lat: _Lattice, scores: list[float], long: tuple | None = None) -> list[tuple[int, int]]:
    """The parts (first, last) of each value on the best path."""
    n = len(lat.spans)
    best, back = [0.0] + [-math.inf] * n, [(-1, -1)] * (n + 1)
    open_, began = [-math.inf] * (n + 1), [-1] * (n + 1)
    by_start: dict[int, list[int]] = defaultdict(list)
    for e, (i, _) in enumerate(lat.edges):
        by_start[i].append(e)
    for i in range(n + 1):
        if long is not None and open_[i] + long[2][i] > best[i]:
            best[i], back[i] = open_[i] + long[2][i], (began[i], i - 1)
        for e in by_start[i]:
            j = lat.edges[e][1]
            if best[i] + scores[e] > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + scores[e], (i, j)
        if long is not None:
            if i < n - LISTED and best[i] + long[0][i] > open_[i + LISTED + 1]:
                open_[i + LISTED + 1], began[i + LISTED + 1] = best[i] + long[0][i], i
            if i < n and open_[i] + long[1][i] > open_[i + 1]:
                open_[i + 1], began[i + 1] = open_[i] + long[1][i], began[i]
    path, at = [], n
    while at:
        path.append(back[at])
        at = back[at][0]
    return path[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _posterior(lat: _Lattice, scores: list[float], long: tuple | None = None) -> list[float]:
    """The chance of each edge; what is missing to one belongs to longer values."""
    n = len(lat.spans)
    fore, after = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    open_, rest = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    by_start: dict[int, list[int]] = defaultdict(list)
    for e, (i, _) in enumerate(lat.edges):
        by_start[i].append(e)
    for i in range(n + 1):
        if long is not None:
            fore[i] = _add(fore[i], open_[i] + long[2][i])
        for e in by_start[i]:
            j = lat.edges[e][1]
            fore[j + 1] = _add(fore[j + 1], fore[i] + scores[e])
        if long is not None:
            if i < n - LISTED:
                open_[i + LISTED + 1] = _add(open_[i + LISTED + 1], fore[i] + long[0][i])
            if i < n:
                open_[i + 1] = _add(open_[i + 1], open_[i] + long[1][i])
    for i in range(n, -1, -1):
        if long is not None and i < n - LISTED:
            after[i] = _add(after[i], long[0][i] + rest[i + LISTED + 1])
        for e in by_start[i]:
            j = lat.edges[e][1]
            after[i] = _add(after[i], scores[e] + after[j + 1])
        if long is not None:
            rest[i] = after[i] + long[2][i]
            if i < n:
                rest[i] = _add(rest[i], long[1][i] + rest[i + 1])
    return [math.exp(min(0.0, fore[i] + scores[e] + after[j + 1] - fore[n])) for e, (i, j) in enumerate(lat.edges)]


def _stats(lexer: _Lexer, value: str, weight: float, into: dict) -> None:
    spans, _ = lexer.pieces(value)
    parts = [_bare(value[a:b]) for a, b in spans]
    into["p", str(min(len(parts), LISTED))] += weight
    for place, cell, shape in _places(parts):
        into["w", f"{place} {cell}"] += weight
        into["s", f"{place} {shape}"] += weight
        into["n", str(place)] += weight
    into["t", ""] += weight


def _models(rows: list, fields: Mapping[str, Grammar]) -> dict[str, Model]:
    out = {f: Model() for f in fields}
    for r in sorted(rows, key=lambda r: r.kind, reverse=True):  # totals first
        m, key = out[r.field], tuple(map(int, r.key.split()))
        if r.kind == "w":
            m.words[key] = r.weight
        elif r.kind == "s":
            m.shapes[key] = r.weight
        elif r.kind == "n":
            m.places[key[0]] = r.weight
        elif r.kind == "p":
            m.parts[key[0]] = r.weight
        elif r.kind == "c":
            m.split[key] = r.weight
        elif r.kind == "t":
            m.total = max(r.weight, 1.0)
        elif r.kind == "1":
            m.novel = min(max(r.weight / m.total, 0.02), 0.5)
    return out


_STATS = "field string, kind string, key string, weight double"


def _frame(stats: dict[str, dict]) -> pd.DataFrame:
    rows = [(f, k, key, w) for f, own in stats.items() for (k, key), w in own.items()]
    return pd.DataFrame(rows, columns=["field", "kind", "key", "weight"])


def split_packed(
    df: DataFrame, key: str, fields: Mapping[str, Grammar], rounds: int = 4
) -> DataFrame:
    """Rows (key, field, pos, item) for each value packed in the `fields` of `df`.

    `pos` counts from 1 in each field. Values are trimmed and lose the quotes around them; doubled quotes inside
    become single; empty values, null and blank fields give no rows and take no position. `key` should name each row
    once; rows with the same key are numbered together. Values may have any number of parts. Columns of `df` other than these are ignored, whatever their names.
    """
    sources = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    texts = df.select(F.col(key).alias("_key"), F.explode(F.array(*sources)).alias("s")).select("_key", "s.field", "s.text")
    texts = texts.where(F.trim("text") != "")

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers = {f: _Lexer(g) for f, g in fields.items()}
        for batch in batches:
            rows = []
            for k, f, text in zip(batch["_key"], batch["field"], batch["text"]):
                rows += [(k, f, i, *c) for i, c in enumerate(lexers[f].chunks(text))]
            yield pd.DataFrame(rows, columns=["_key", "field", "no", "piece", "kind", "gap"])

    key_type = df.schema[key].dataType.simpleString()
    pieces = cut(texts.mapInPandas(lex, f"_key {key_type}, field string, no int, piece string, kind int, gap string"))  # read once

    def piece_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers, stats = {f: _Lexer(g) for f, g in fields.items()}, {f: defaultdict(float) for f in fields}
        for batch in batches:
            for f, c, n in zip(batch["field"], batch["piece"], batch["n"]):
                if len(lexers[f].pieces(c)[0]) == 1 or not fields[f].weak or fields[f].names:
                    _stats(lexers[f], c, n, stats[f])
        yield _frame(stats)

    # The strong level. Pieces behind a field's usual separator tell how values begin and go on.
    distinct = cut(pieces.groupBy("field", "kind", "piece").agg(F.count("*").cast("double").alias("n")))
    usual: dict[str, tuple[float, int]] = {}
    for r in distinct.where("kind >= 0").groupBy("field", "kind").agg(F.sum("n").alias("n")).collect():  # fields times kinds
        usual[r.field] = max(usual.get(r.field, (0.0, 0)), (r.n, -r.kind))
    seeds = F.concat_ws(" ", "field", "kind").isin([f"{f} {k}" for f in fields for k in (-1, -usual.get(f, (0.0, 0))[1])])
    looks = distinct.where(seeds).groupBy("field", "piece").agg(F.sum("n").alias("n")).mapInPandas(piece_stats, _STATS).groupBy("field", "kind", "key").agg(F.sum("weight").alias("weight"))
    first_models = _models(looks.collect(), fields)  # at most PLACES * CELLS word cells a field

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers = {f: _Lexer(g) for f, g in fields.items()}
        for batch in batches:
            odds = []
            for f, c in zip(batch["field"], batch["piece"]):
                a, b = lexers[f].pieces(c)[0][0]
                odds.append(first_models[f].begins(_bare(c[a:b])))
            yield batch[["field", "kind", "piece", "n"]].assign(odds=odds)

    edges = cut(distinct.where("kind >= 0").mapInPandas(evidence, "field string, kind int, piece string, n double, odds double"))
    prior = {(f, k): math.log(PRIOR[0] / PRIOR[1]) for f in fields for k in range(len(STRONG))}

    def posterior() -> Column:
        cases = F.create_map(*[x for (f, k), v in prior.items() for x in (F.lit(f"{f} {k}"), F.lit(v))])
        return F.col("odds") + cases[F.concat_ws(" ", "field", "kind")]

    for _ in range(rounds):
        chance = 1.0 / (1.0 + F.exp(F.least(-posterior(), F.lit(500.0))))
        for r in edges.groupBy("field", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * chance).alias("cuts")).collect():  # fields times kinds
            prior[r.field, r.kind] = math.log(r.cuts + PRIOR[0]) - math.log(max(r.n - r.cuts, 0.0) + PRIOR[1])
    going_on = edges.where(posterior() < 0.0).select("field", "kind", "piece", F.lit(True).alias("joins"))
    judged = pieces.join(going_on, ["field", "kind", "piece"], "left")
    whole = Window.partitionBy("_key", "field").orderBy("no")
    # Only texts in which a strong separator belongs to a value are put together again.
    mended = judged.join(judged.where("joins").select("_key", "field").distinct(), ["_key", "field"], "left_semi")
    mended = mended.withColumn("no", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(whole).cast("int"))
    bits = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("joins"), F.col("gap")).otherwise("").alias("gap"), "piece")))
    mended = mended.withColumn("at", F.row_number().over(whole)).groupBy("_key", "field", "no").agg(bits.alias("b"))
    mended = mended.select("_key", "field", "no", F.array_join(F.flatten(F.transform("b", lambda x: F.array(x["gap"], x["piece"]))), "").alias("chunk"))
    plain = pieces.join(judged.where("joins").select("_key", "field").distinct(), ["_key", "field"], "left_anti").select("_key", "field", "no", F.col("piece").alias("chunk"))
    several = F.max("no").over(Window.partitionBy("_key", "field")) > F.min("no").over(Window.partitionBy("_key", "field"))
    opened = F.expr("false")
    for f, g in fields.items():
        if g.weak:
            opened = F.when(F.col("field") == f, F.col("chunk").rlike("|".join(g.weak))).otherwise(opened)
    chunks = cut(plain.unionByName(mended).withColumn("context", several.cast("int")).withColumn("open", opened))
    lattices = cut(
        chunks.where("open").groupBy("field", "context", "chunk").agg(F.count("*").cast("double").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    weak = {f: g for f, g in fields.items() if g.weak}
    closed = chunks.where(~F.col("open") & F.col("field").isin(*weak)).groupBy("field", "chunk").agg(F.count("*").cast("double").alias("n"))

    def closed_stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers, stats = {f: _Lexer(g) for f, g in weak.items()}, {f: defaultdict(float) for f in weak}
        for batch in batches:
            for f, c, n in zip(batch["field"], batch["chunk"], batch["n"]):
                _stats(lexers[f], c, n, stats[f])
                stats[f]["v", _key(_bare(c), lexers[f])] += n
        yield _frame(stats)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers = {f: _Lexer(g) for f, g in weak.items()}
        for batch in batches:
            batch["values"] = [[_key(_bare(v), lexers[f]) for v in _lattice(lexers[f], c).values] for f, c in zip(batch["field"], batch["chunk"])]
            yield batch

    spread = lattices.mapInPandas(spans, "field string, context int, chunk string, n double, cid bigint, values array<string>")
    spread = spread.select("cid", "field", F.posexplode("values").alias("e", "v"))
    seen = cut(closed.mapInPandas(closed_stats, _STATS).groupBy("field", "kind", "key").agg(F.sum("weight").alias("weight")))
    fixed, known = seen.where("kind <> 'v'"), seen.where("kind = 'v'").select("field", "key", "weight")

    def counted(values: DataFrame) -> DataFrame:
        sums = values.groupBy(F.col("field").alias("vf"), F.col("key").alias("vk")).agg(F.sum("weight").alias("count"))
        met = spread.join(sums, (F.col("field") == F.col("vf")) & (F.col("v") == F.col("vk")), "left")
        per = met.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("e", F.coalesce("count", F.lit(0.0)).alias("count")))).alias("counts"))
        # A chunk's own copies are no evidence for its values.
        elsewhere = F.transform("counts", lambda c: F.greatest(c["count"] - F.col("n"), F.lit(0.0)))
        return lattices.join(per, "cid").select("field", "context", "chunk", "n", elsewhere.alias("counts"))

    def expect(models: dict[str, Model]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexers, stats = {f: _Lexer(g) for f, g in weak.items()}, {f: defaultdict(float) for f in weak}
            for batch in batches:
                for f, context, c, n, counts in zip(*(batch[x] for x in ("field", "context", "chunk", "n", "counts"))):
                    lat = _lattice(lexers[f], c)
                    for e, p in enumerate(_posterior(lat, _scores(lat, c, context, list(counts), models[f]), _long(lat, c, context, models[f]))):
                        if p < 1e-4:
                            continue
                        (i, j), w = lat.edges[e], p * n
                        stats[f]["v", _key(_bare(lat.values[e]), lexers[f])] += w
                        _stats(lexers[f], lat.values[e], w, stats[f])
                        for k in lat.kinds[i:j]:
                            stats[f]["c", f"{context} {k} 0"] += w
                        if j < len(lat.kinds):
                            stats[f]["c", f"{context} {lat.kinds[j]} 1"] += w
            yield _frame(stats)

        return run

    def once(values: DataFrame) -> DataFrame:
        sums = values.groupBy("field", "key").agg(F.sum("weight").alias("weight")).where("weight < 1.5")
        return sums.groupBy("field").agg(F.sum("weight").alias("weight")).select("field", F.lit("1").alias("kind"), F.lit("0").alias("key"), "weight")

    def summed(stats: DataFrame, values: DataFrame) -> dict[str, Model]:
        total = stats.groupBy("field", "kind", "key").agg(F.sum("weight").alias("weight"))
        return _models(total.unionByName(once(values)).collect(), weak)  # at most PLACES * CELLS word cells a field

    models, values = summed(fixed, known), known
    for _ in range(rounds):
        learned = cut(counted(values).mapInPandas(expect(models), _STATS).groupBy("field", "kind", "key").agg(F.sum("weight").alias("weight")))
        values = known.unionByName(learned.where("kind = 'v'").select("field", "key", "weight"))
        models = summed(fixed.unionByName(learned.where("kind <> 'v'")), values)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexers = {f: _Lexer(g) for f, g in weak.items()}
        for batch in batches:
            items = []
            for f, context, c, counts in zip(*(batch[x] for x in ("field", "context", "chunk", "counts"))):
                lat = _lattice(lexers[f], c)
                path = _viterbi(lat, _scores(lat, c, context, list(counts), models[f]), _long(lat, c, context, models[f]))
                items.append([c[lat.spans[i][0] : lat.spans[j][1]] for i, j in path])
            yield pd.DataFrame({"field": batch["field"], "context": batch["context"], "chunk": batch["chunk"], "items": items})

    chosen = counted(values).mapInPandas(choose, "field string, context int, chunk string, items array<string>")
    # Chunks without a choice keep their place; only lattices meet their paths.
    parted = chunks.where("open").join(chosen, ["field", "context", "chunk"]).select("_key", "field", "no", F.posexplode("items").alias("sub", "raw"))
    parted = parted.unionByName(chunks.where(~F.col("open")).select("_key", "field", "no", F.lit(0).alias("sub"), F.col("chunk").alias("raw")))
    raw = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    straight = raw.rlike(r'^"(?:[^"]++|"")*+"$') & (F.length(raw) > 1)
    curly = raw.rlike(r"^[“„].*[”“]$") & (F.length(raw) > 1)
    inner = F.regexp_replace(F.substr(raw, F.lit(2), F.length(raw) - 2), r"^\s+|\s+$", "")
    item = F.when(straight, F.replace(inner, F.lit('""'), F.lit('"'))).when(curly, inner).otherwise(raw)
    order = Window.partitionBy("_key", "field").orderBy("no", "sub")
    return (
        parted.withColumn("item", item).where(F.col("item") != "")
        .withColumn("pos", F.row_number().over(order).cast("int"))
        .select(F.col("_key").alias(key), "field", "pos", "item")
    )


def latest_records(df: DataFrame, key: str = "ut", time: str = "loaded_at") -> DataFrame:
    """One row per record: of the rows that share a key the one loaded last, ties broken by content.

    Rows without a key are records of their own unless all their columns agree.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)))
    rest = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(F.col(time), F.to_json(rest))
    return df.groupBy(own.alias("_own")).agg(F.max_by(rest, order).alias("r")).select("_own", "r.*")
