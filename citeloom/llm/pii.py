"""Personal information in free text, found by a linear-chain conditional random field.

The field scores word shapes, word ends, words and small word lists of a token and its two neighbours on either side,
pairs of neighbouring shapes, and pairs of neighbouring labels. It is trained by gradient ascent on the likelihood of
a small labelled table (`pii_examples`) and decoded by Viterbi for many windows at once in numpy. Because a token's
score is a sum over its neighbours, it is computed once per distinct token and looked up.

Whole texts are decoded, token by token. Long ones are laid out in segments that overlap by OVERLAP tokens on either
side; a label is taken from the segment that has its token farther inside, so that memory is bounded by the segment.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.pii_examples import GIVEN, TITLES, labelled_sentences

TYPES = ("name", "email", "phone", "id_number", "street_address")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
_BEGINS = np.array([lab[0] == "B" for lab in LABELS])
CELLS = 1 << 14
NEAR = (-2, -1, 0, 1, 2)
SEGMENT, OVERLAP = 384, 64  # tokens
KEPT = 200_000  # distinct tokens whose scores a worker keeps, 50 MB

# Words that tell addresses, titles and sentence openings that are no given names.
STREET_WORDS = frozenset("street st road rd lane avenue ave court drive terrace close way square place blvd boulevard crescent row gardens hill walk rue impasse quai calle avenida plaza paseo chemin allee".split())
STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee")
FLAT_WORDS = frozenset("flat apt apartment suite unit box postfach apartado bp po p".split())
OPENINGS = frozenset(
    "a after although and as at before between both but by contrary data das der des die du each earlier few for from he her his how i if in it its la le les el los las many "
    "models most nach neither no not of on one or our readers she since so some such table that the their there these they this those though to under until using was we "
    "weder were what when where which while who with within without dass en entre ni selon según ein eine il elle à al un une una on see "
    "zwischen bei mit für von aus depuis dans pour par sur chez tras desde con sin por para bajo hasta sobre".split()
)
_PARTICLES = frozenset("van von de der den di da del du la le mac mc ter ten y zu".split())
_GIVEN = frozenset(g.lower() for g in GIVEN)
_TITLES = frozenset(t.lower().rstrip(".") for t in TITLES)

_TOKEN = re.compile(r"\w+|[^\w\s]")


@lru_cache(maxsize=200_000)
def _shape(word: str) -> str:
    out = ""
    for c in word:
        k = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out.endswith(k * 3) or k == "9" and len(out) < 12:
            out += k
    return out


def _token_features(word: str) -> list[str]:
    low = word.lower()
    shape = _shape(word)
    feats = [f"s{shape}", f"w{low}", f"e{low[-3:]}", f"b{low[:2]}", f"#{min(len(word), 12)}"]
    if low in _GIVEN:
        feats.append("given")
    if low in _TITLES:
        feats.append("title")
    if low in STREET_WORDS or low.endswith(STREET_ENDS):
        feats.append("street")
    if low in FLAT_WORDS:
        feats.append("flat")
    if low in OPENINGS:
        feats.append("open")
    if word[:1].isupper():
        feats.append("cap" if len(word) > 1 else "initial")
    if word.isdigit():
        feats.append("year" if len(word) == 4 and "1700" < word < "2100" else f"digits{min(len(word), 7)}")
    elif any(c.isdigit() for c in word):
        feats.append("mixed")
    return feats


_MOST = 12


def _cells(word: str, veiled: bool = False) -> list[int]:
    own = [zlib.crc32(f.encode()) % (CELLS - 1) + 1 for f in _token_features(word) if not veiled or f[0] not in "web"][:_MOST]
    return own + [0] * (_MOST - len(own))


_SHAPES = 128


def _pair_shape(word: str) -> int:
    coarse = re.sub(r"(.)\1+", r"\1", _shape(word))
    return zlib.crc32(coarse.encode()) % _SHAPES


class Field:
    """The trained model: `near[k]` scores of each feature cell at offset NEAR[k], shape pairs, label transitions."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.near = np.zeros((len(NEAR), CELLS, n), np.float32)
        self.pairs = np.zeros((_SHAPES * _SHAPES, n), np.float32)
        self.trans = np.zeros((n, n), np.float32)
        for j, lab in enumerate(LABELS):  # an inner label only follows its own type
            if lab[0] == "I":
                for i, before in enumerate(LABELS):
                    if before[2:] != lab[2:]:
                        self.trans[i, j] = -30.0
        self.start = np.array([-30.0 if lab[0] == "I" else 0.0 for lab in LABELS], np.float32)

    def table(self, cells: np.ndarray) -> np.ndarray:
        """Scores of distinct tokens at each offset: offsets x tokens x labels."""
        out = np.empty((len(NEAR), len(cells), len(LABELS)), np.float32)
        for k in range(len(NEAR)):
            out[k] = self.near[k][cells].sum(1)
        return out

    def unary(self, table: np.ndarray, grid: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Scores of padded rows of token numbers (0 is padding)."""
        rows, width = grid.shape
        u = np.zeros((rows, width, len(LABELS)), np.float32)
        for k, off in enumerate(NEAR):
            u += table[k][_shifted(grid, off)]
        before = _shifted(shapes, -1)
        u += self.pairs[before * _SHAPES + shapes]
        return u

    def viterbi(self, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all rows at once."""
        rows, width, n = u.shape
        back = np.zeros((rows, width, n), np.int8)
        score = self.start + u[:, 0]
        last = score.copy()
        for t in range(1, width):
            step = score[:, :, None] + self.trans
            back[:, t] = step.argmax(1)
            score = step.max(1) + u[:, t]
            ended = lengths == t + 1
            last[ended] = score[ended]
        labels = np.zeros((rows, width), np.int8)
        at = last.argmax(1)
        for t in range(width - 1, -1, -1):
            inside = t < lengths
            labels[:, t] = np.where(inside, at, 0)
            at = np.where(inside, back[np.arange(rows), t, at], at)
        return labels


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


class _Numbering:
    """Numbers distinct tokens; 0 is padding."""

    def __init__(self) -> None:
        self.numbers: dict[str | tuple[str, bool], int] = {}
        self.cells: list[list[int]] = [[0] * _MOST]
        self.shapes: list[int] = [0]

    def number(self, word: str, veiled: bool = False) -> int:
        """A veiled token is seen by its shape and lists only, as a word never met would be."""
        key = (word, veiled) if veiled else word
        k = self.numbers.get(key)
        if k is None:
            k = self.numbers[key] = len(self.cells)
            self.cells.append(_cells(word, veiled))
            self.shapes.append(_pair_shape(word))
        return k


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    grid = np.zeros((len(rows), int(lengths.max())), np.int32)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.concatenate([np.array(r, np.int32) for r in rows])
    return grid, lengths


@lru_cache(maxsize=2)
def train(rounds: int = 80, epochs: int = 5, seed: int = 11, veil: float = 0.2) -> Field:
    """Fit the field by AdaGrad on exact log-likelihood gradients (forward-backward) of small batches.

    A share `veil` of the tokens is veiled, so that neighbours never met in training are nothing new.
    """
    numbering, rows, gold, chance = _Numbering(), [], [], random.Random(seed)
    for text, places in labelled_sentences(rounds, seed):
        spans = _tokens(text)
        labels = []
        for a, b in spans:
            hit = next((p for p in places if p[0] <= a and b <= p[1]), None)
            labels.append(0 if hit is None else LABELS.index(f"{'B' if a == hit[0] else 'I'}-{hit[2]}"))
        rows.append([numbering.number(text[a:b], chance.random() < veil and text[a:b].isalpha()) for a, b in spans])
        gold.append(labels)
    cells, shape_of = np.array(numbering.cells), np.array(numbering.shapes)
    order = np.argsort([len(r) for r in rows], kind="stable")
    batches = [(*_padded([rows[k] for k in part]), _padded([gold[k] for k in part])[0]) for part in np.array_split(order, -(-len(rows) // 64))]
    field, order_of = Field(), np.random.default_rng(seed)
    params = [field.near, field.pairs, field.trans]
    squares = [np.full_like(p, 1.0) for p in params]
    means, taken = [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for k in order_of.permutation(len(batches)):
            # Each parameter comes with the rows of it that the batch touches.
            for (at, g), p, q in zip(_gradients(field, cells, shape_of, *batches[k]), params, squares):
                own = q[at] + g * g
                q[at] = own
                p[at] += 0.5 * g / np.sqrt(own)
        field.near *= 0.995
        field.pairs *= 0.995
        if epoch >= epochs // 2:  # the mean over the later rounds is steadier than any of them
            taken += 1
            for m, p in zip(means, params):
                m += p
    for m, p in zip(means, params):
        p[...] = m / taken
    return field


def _gradients(field: Field, cells: np.ndarray, shape_of: np.ndarray, grid: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    n, width = len(LABELS), grid.shape[1]
    inside = np.arange(width) < lengths[:, None]
    shapes = shape_of[grid]
    used, own = np.unique(grid, return_inverse=True)  # scores of the batch's tokens only
    own = own.reshape(grid.shape)
    if used[0] != 0:
        used, own = np.concatenate([[0], used]), own + 1
    u = field.unary(field.table(cells[used]), own, shapes)
    a, b = np.zeros_like(u), np.zeros_like(u)
    a[:, 0] = field.start + u[:, 0]
    for t in range(1, width):
        x = a[:, t - 1, :, None] + field.trans
        top = x.max(1, keepdims=True)
        a[:, t] = np.where(inside[:, t, None], top[:, 0] + np.log(np.exp(x - top).sum(1)) + u[:, t], a[:, t - 1])
    whole = a[:, -1]
    log_z = whole.max(1) + np.log(np.exp(whole - whole.max(1, keepdims=True)).sum(1))
    expected = np.zeros((n, n), np.float32)
    for t in range(width - 2, -1, -1):
        x = field.trans + (u[:, t + 1] + b[:, t + 1])[:, None, :]
        top = x.max(2, keepdims=True)
        b[:, t] = np.where(inside[:, t + 1, None], top[..., 0] + np.log(np.exp(x - top).sum(2)), 0.0)
        expected += (np.exp(np.minimum(a[:, t, :, None] + x - log_z[:, None, None], 0.0)) * inside[:, t + 1, None, None]).sum(0)
    diff = (np.eye(n, dtype=np.float32)[truth] - np.exp(np.minimum(a + b - log_z[:, None, None], 0.0))) * inside[..., None]
    seen = np.zeros((n, n), np.float32)
    np.add.at(seen, (truth[:, :-1][inside[:, 1:]], truth[:, 1:][inside[:, 1:]]), 1.0)
    flat = diff[inside]
    touched, place = np.unique(cells[used].ravel(), return_inverse=True)
    near = np.empty((len(NEAR), len(touched), n), np.float32)
    for k, off in enumerate(NEAR):
        per_token = _sum_by(_shifted(own, off)[inside], flat, len(used))
        near[k] = _sum_by(place, np.repeat(per_token, _MOST, axis=0), len(touched))
    near[:, touched == 0] = 0.0
    met, place = np.unique((_shifted(shapes, -1) * _SHAPES + shapes)[inside], return_inverse=True)
    whole = (slice(None),)
    return [((slice(None), touched), near), ((met,), _sum_by(place, flat, len(met))), (whole, np.where(field.trans < -20, 0.0, seen - expected))]


def _shifted(grid: np.ndarray, off: int) -> np.ndarray:
    """The grid seen `off` places further on; 0 outside."""
    out = np.zeros_like(grid)
    if off < 0:
        out[:, -off:] = grid[:, :off]
    elif off > 0:
        out[:, :-off] = grid[:, off:]
    else:
        out = grid
    return out


def _sum_by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], axis=1).astype(np.float32)


class Tagger:
    """A field with the scores of the tokens it has met; forgets them when they are more than KEPT."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.numbering = _Numbering()
        self.scores = self.field.table(np.array(self.numbering.cells))
        self.shapes = np.array(self.numbering.shapes)

    def numbers(self, words: list[str]) -> list[int]:
        known, number = self.numbering.numbers, self.numbering.number
        return [k if (k := known.get(w)) is not None else number(w) for w in words]

    def learn(self) -> None:
        """Scores of the tokens that are new since the last time."""
        had = len(self.shapes)
        if had < len(self.numbering.shapes):
            self.scores = np.concatenate([self.scores, self.field.table(np.array(self.numbering.cells[had:]))], axis=1)
            self.shapes = np.array(self.numbering.shapes)


def tag(field: Field | Tagger, texts: list[str], segment: int = SEGMENT) -> list[list[tuple[int, int, str]]]:
    """Places (start, end, type) in each text."""
    tagger = field if isinstance(field, Tagger) else Tagger(field)
    field = tagger.field
    if len(tagger.shapes) > KEPT:
        tagger.forget()
    parts, rows, spans = [], [], [_tokens(t) for t in texts]
    for i, (text, own) in enumerate(zip(texts, spans)):
        numbers = tagger.numbers([text[x:y] for x, y in own])
        for core in range(0, len(own), segment):
            low, high = max(0, core - OVERLAP), min(len(own), core + segment + OVERLAP)
            parts.append((i, core, core - low, min(segment, len(own) - core)))
            rows.append(numbers[low:high])
    labels = [np.zeros(len(own), np.int8) for own in spans]
    if rows:
        tagger.learn()
        order = np.argsort([len(r) for r in rows], kind="stable")
        for lo in range(0, len(order), 256):
            batch = order[lo : lo + 256]
            grid, lengths = _padded([rows[k] for k in batch])
            for k, row in zip(batch, field.viterbi(field.unary(tagger.scores, grid, tagger.shapes[grid]), lengths)):
                i, core, skip, n = parts[k]
                labels[i][core : core + n] = row[skip : skip + n]
    places: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, (own, row) in enumerate(zip(spans, labels)):
        for b in np.flatnonzero(_BEGINS[row]):
            e = b + 1
            while e < len(row) and row[e] == row[b] + 1:  # the inner label of a type follows its first one
                e += 1
            places[i].append((own[b][0], own[e - 1][1], LABELS[row[b]][2:]))
    return [[p for p in ps if _plausible(t, *p)] for t, ps in zip(texts, places)]


def _plausible(text: str, a: int, b: int, kind: str) -> bool:
    """What the type's definition needs at the least."""
    digits = sum(c.isdigit() for c in text[a:b])
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text[a:b], re.I))
    words = [w for w in re.findall(r"[\w'’-]+", text[a:b]) if w.lower() not in _PARTICLES]
    return len(words) > 1 and all(w[0].isupper() for w in words) and not digits


def find_places(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, pii_type, start_pos, end_pos): every place of the whole texts, positions in characters from 0.

    Null and empty texts and empty tables give no rows; repeated rows give their places again; other columns are
    ignored.
    """
    field = train()
    kind = documents.schema[doc_id].dataType.simpleString()
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(field)  # its size is fixed by CELLS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                found = tag(tagger, part["t"].tolist())
                rows = [(d, k, a, b) for d, ps in zip(part["d"], found) for a, b, k in ps]
                yield pd.DataFrame(rows, columns=["d", "pii_type", "start_pos", "end_pos"])

    texts = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return texts.mapInPandas(run, f"d {kind}, pii_type string, start_pos int, end_pos int").withColumnRenamed("d", doc_id)


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, n_places) with typed placeholders such as [NAME]; null and empty texts stay as they are."""
    field = documents.sparkSession.sparkContext.broadcast(train())
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field.value)
        for batch in batches:
            texts = [t or "" for t in batch["t"]]
            out, counts = [], []
            for t, ps in zip(texts, (ps for lo in range(0, len(texts), 512) for ps in tag(tagger, texts[lo : lo + 512]))):
                bits, at = [], 0
                for a, b, k in ps:
                    bits += [t[at:a], f"[{k.upper()}]"]
                    at = b
                out.append("".join([*bits, t[at:]]))
                counts.append(len(ps))
            blank = batch["t"].isna()
            yield pd.DataFrame({"d": batch["d"], "t": pd.Series(out, index=batch.index).mask(blank, None), "n": counts})

    texts = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return texts.mapInPandas(run, f"d {kind}, t string, n int").select(F.col("d").alias(doc_id), F.col("t").alias(text), F.col("n").alias("n_places"))
