"""Evaluation texts leaking into training text, found by latent semantic retrieval.

Documents are cut into passages of 24 words, each 12 words after the last, and items into passages of 15 words, each
4 after the last: any 12 successive words that both share lie whole in a passage of either. Passages are TF-IDF
vectors over the words of the items, projected onto the leading singular vectors that a distributed randomised SVD
finds. Item passages lie in cells around centroids; a document passage is compared with the passages of those cells
whose centroid is near enough, and pairs above a least cosine are candidates. Only candidates are read word by word: a
run of 12 words is a leak, and for the report a longest common subsequence with the answer beside it marks paraphrases.

Both limits, for centroids and for passages, are set from runs planted into every document: for leaks so that all of
these are found, for paraphrases, of which each candidate pair is read, so that all but a thousandth are. The items, their words and vectors go to all workers; `MAX_ITEM_WORDS` bounds them.
Document frequencies are counted over all documents, and the singular vectors are fitted on all their passages.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citeloom.runtime import cut

RUN = 12  # successive words that make a leak
WIDE, STEP = 24, 12  # document passages
NARROW, STRIDE = 15, 4  # item passages
DIMENSIONS, EXTRA, POWERS = 64, 10, 2
MOST_PAIRS = 1 << 22  # pairs of words that a worker counts at once, 32 MB; of more words products are added up, in every round
PART_CELLS = 1024  # numbers of a matrix that are added up as one row
MIN_COSINE = 0.4  # of candidates at the most; planted runs lower it
MOST_WEIGHT = 4.0  # a word in fewer than two of a hundred documents weighs no more, else it hides the words around it
MAX_ITEM_WORDS = 2_000_000  # half a million passages, 128 MB of vectors in each worker; more is refused, never cut
FINE = 10_000  # steps of 1 that cosines of planted runs are counted in

_BRACKET = re.compile(r"[(\[]([^()\[\]]*+)[)\]]")
_YEAR = re.compile(r"\d{4}")
_CUT = re.compile(r"[-­‐‑][ \t]*\r?\n\s*")
_WORD = re.compile(r"\w+")
_MARKS = str.maketrans("", "", "-­‐‑'’")


def _without_citation(bracket: re.Match) -> str:
    """A bracket with years is a citation if it is no longer than its works could make it; else it is text."""
    years = len(_YEAR.findall(bracket[1]))
    return " " if years and len(bracket[1]) <= 300 + 100 * years else bracket[0]


def plain_words(text: str | None) -> list[str]:
    """Words without case, punctuation, hyphens, cuts at line ends and bracketed citations, however many works these name."""
    if not text:
        return []
    if "(" in text or "[" in text:
        text = _BRACKET.sub(_without_citation, text)
    return _WORD.findall(_CUT.sub("", text).translate(_MARKS).casefold())


@dataclass(frozen=True)
class ItemIndex:
    """The items as word numbers, their 12-word runs and the places of their passages."""

    ids: np.ndarray
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    answers: list[list[int]]
    run_keys: np.ndarray
    run_items: np.ndarray

    @property
    def size(self) -> int:
        return len(self.vocabulary)


def _run_hashes(words: np.ndarray) -> np.ndarray:
    """One number for each run of RUN words; runs of different words differ but for one chance in 2^64."""
    if len(words) < RUN:
        return np.zeros(0, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(words) - RUN + 1, np.uint64)
    for k in range(RUN):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : len(words) - RUN + 1 + k]
    return total


def _run_hashes_of(passages: np.ndarray) -> np.ndarray:
    """The same numbers for the runs in each row of passages."""
    mixed = (passages.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros((len(passages), passages.shape[1] - RUN + 1), np.uint64)
    for k in range(RUN):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[:, k : passages.shape[1] - RUN + 1 + k]
    return total


def index_items(items: DataFrame, item_id: str, text: str, answer: str) -> ItemIndex:
    """Read the held-out items; they are few by their nature, and more than MAX_ITEM_WORDS words are refused."""
    rows, total = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t"), F.col(answer).alias("a")).distinct().toLocalIterator():
        words = plain_words(r.t)
        total += len(words)
        if total > MAX_ITEM_WORDS:
            raise ValueError("more item text than workers may hold; split the items into several calls")
        if r.i is not None and words:
            rows.append((r.i, words, plain_words(r.a)))
    rows.sort(key=lambda r: (r[0], r[1]))
    vocabulary: dict[str, int] = {}
    numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int32) for _, ws, _ in rows]
    answers = [[vocabulary.setdefault(w, len(vocabulary)) for w in a] for _, _, a in rows]
    keys = [_run_hashes(w) for w in numbered]
    owners = np.concatenate([np.full(len(k), j) for j, k in enumerate(keys)]) if rows else np.zeros(0, int)
    flat = np.concatenate(keys) if rows else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    return ItemIndex(np.array([r[0] for r in rows], np.int64), numbered, vocabulary, answers, flat[order], owners[order].astype(np.int64))


def _passages(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid one after another in whole blocks of STEP: number of blocks, first block, passages."""
    blocks = np.maximum(1, -(-lengths // STEP))
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64)
    return blocks, first, np.maximum(1, blocks - 1)


def _laid(words: list[np.ndarray], empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks x STEP word numbers (`empty` where none), and for each passage its document and first block."""
    lengths = np.array([len(w) for w in words])
    blocks, first, n = _passages(lengths)
    grid = np.full(int(blocks.sum()) * STEP, empty, np.int32)
    at = np.repeat(first * STEP, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    grid[at] = np.concatenate(words) if len(words) else 0
    doc = np.repeat(np.arange(len(words)), n)
    start = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return grid.reshape(-1, STEP), doc, start


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _vectors(grid: np.ndarray, doc: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the word vectors of each passage."""
    if not len(doc):
        return np.zeros((0, table.shape[1]), np.float32)
    sums = np.empty((len(grid), table.shape[1]), np.float32)
    for a in range(0, len(grid), 8192):
        sums[a : a + 8192] = table[grid[a : a + 8192]].sum(1)
    second = np.minimum(start + 1, len(grid) - 1)
    return sums[start] + sums[second] * (~_alone(doc, start, len(grid)))[:, None]


def _alone(doc: np.ndarray, start: np.ndarray, n_blocks: int) -> np.ndarray:
    """Whether a passage is a document of one block, so that the next block is another document's."""
    new = np.append(True, doc[1:] != doc[:-1])
    last = np.append(doc[1:] != doc[:-1], True)
    return new & last & (np.append(start[1:], n_blocks) - start == 1)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def encode_documents(documents: DataFrame, doc_id: str, text: str, index: ItemIndex) -> DataFrame:
    """Rows (d, words): the texts as numbers of the items' words; all other words share one number."""
    vocabulary, other = index.vocabulary, index.size

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for batch in batches:
            coded = [np.array([get(w, other) for w in plain_words(t)], np.int32).tobytes() for t in batch["t"]]
            yield pd.DataFrame({"d": batch["d"], "words": coded})

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(encode, f"d {kind}, words binary")


def inverse_document_frequency(coded: DataFrame, size: int) -> np.ndarray:
    """Over all documents; partitions send one count for each word they hold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            words = [np.unique(_numbers(w)) for w in batch["words"]]
            n += len(words)
            if words:
                seen += np.bincount(np.concatenate(words), minlength=size + 1)
        held = np.nonzero(seen[:size])[0]
        yield pd.DataFrame({"w": np.append(held, -1).astype("int32"), "n": np.append(seen[held], n)})

    got = {r.w: r.n for r in coded.mapInPandas(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(-1, 0) or 0
    df = np.zeros(size + 1)
    df[list(got)] = list(got.values())
    idf = np.minimum(np.log((total + 1.0) / (df + 1.0)) + 0.05, MOST_WEIGHT)
    idf[size] = 0.0
    return idf.astype(np.float32)


def _product(words: list[np.ndarray], table: np.ndarray, size: int) -> np.ndarray:
    """Passages transposed times passages times `table`, without the weights on the left.

    A passage is two blocks, so a block takes what its passages came to, and its words take what their block took.
    """
    out = np.zeros((size + 1, table.shape[1]))
    words = [w for w in words if len(w)]
    if not words:
        return out
    grid, doc, start = _laid(words, size)
    y = _vectors(grid, doc, start, table)
    taken = np.zeros((len(grid), table.shape[1]), np.float32)
    taken[start] = y
    double = ~_alone(doc, start, len(grid))
    taken[start[double] + 1] += y[double]
    for a in range(0, len(grid), 4096):
        flat = grid[a : a + 4096].ravel()
        known = np.flatnonzero(flat < size)
        if len(known):
            known = known[np.argsort(flat[known].astype(np.uint16) if size < 1 << 16 else flat[known], kind="stable")]
            first = np.flatnonzero(np.append(True, np.diff(flat[known]) != 0))
            out[flat[known][first]] += np.add.reduceat(taken[a : a + 4096][known // STEP], first, axis=0)
    return out


def _pairs(words: list[np.ndarray], size: int) -> np.ndarray:
    """Passages transposed times passages: how often two words, with themselves too, are met in one passage.

    The last row and column, of all other words and of no words, say nothing.
    """
    n = size + 1
    half, own = np.zeros(n * n, np.int64), np.zeros(n, np.int64)
    words = [w for w in words if len(w)]
    grid, doc, start = _laid(words, size) if words else (np.zeros((0, STEP), np.int32), np.zeros(0, int), np.zeros(0, int))
    double = ~_alone(doc, start, len(grid))
    passages = np.bincount(np.append(start, start[double] + 1), minlength=len(grid))  # of each block, one or two
    left, right = np.triu_indices(STEP, 1)
    for times in (1, 2):
        blocks = np.flatnonzero(passages == times)
        for a in range(0, len(blocks), 8192):
            some = grid[blocks[a : a + 8192]].astype(np.int64)
            half += times * np.bincount((some[:, left] * n + some[:, right]).ravel(), minlength=n * n)
            own += times * np.bincount(some.ravel(), minlength=n)
    firsts = start[double]
    for a in range(0, len(firsts), 8192):
        some, then = grid[firsts[a : a + 8192]].astype(np.int64), grid[firsts[a : a + 8192] + 1]
        half += np.bincount((some[:, :, None] * n + then[:, None, :]).ravel(), minlength=n * n)
    half = half.reshape(n, n)
    return half + half.T + np.diag(own)


def _added_up(coded: DataFrame, matrix: Callable[[list[np.ndarray]], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum of a rows x columns matrix of documents over all of them; tasks add up, and one matrix comes back."""
    step = max(1, PART_CELLS // columns)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((rows, columns))
        for batch in batches:
            for lo in range(0, len(batch), 512):
                out += matrix([_numbers(w) for w in batch["words"].iloc[lo : lo + 512]])
        yield pd.DataFrame({"k": range(0, rows, step), "m": [out[k : k + step].tobytes() for k in range(0, rows, step)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch["k"], batch["m"]):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(m)
        yield pd.DataFrame({"k": list(sums), "m": [m.tobytes() for m in sums.values()]})

    total = np.zeros((rows, columns))
    for r in coded.mapInPandas(whole, "k int, m binary").repartition("k").mapInPandas(add, "k int, m binary").collect():
        total[r.k : r.k + step] = np.frombuffer(r.m).reshape(-1, columns)
    return total


def singular_vectors(coded: DataFrame, idf: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """(words + 1) x DIMENSIONS projection of TF-IDF passages, by randomised subspace iteration.

    All passages of documents and items take part. Where pairs of words are at most MOST_PAIRS, they are counted once and
    multiplied here; else each round multiplies the passages of every partition with the same small matrix, and one
    words x (DIMENSIONS + EXTRA) matrix comes back.
    """
    size = len(idf) - 1
    width = min(DIMENSIONS + EXTRA, size)
    basis = np.random.default_rng(7).standard_normal((size, width)).astype(np.float32)
    together = (size + 1) ** 2 <= MOST_PAIRS
    pairs = _added_up(coded, lambda words: _pairs(words, size), size + 1, size + 1) + _pairs(items, size) if together else None
    for _ in range(POWERS + 1):
        table = np.vstack([basis * idf[:size, None], np.zeros((1, width), np.float32)])
        if together:
            image = pairs @ table
        else:
            image = _added_up(coded, lambda words, table=table: _product(words, table, size), size + 1, width) + _product(items, table, size)
        image = image[:size] * idf[:size, None]
        basis = np.linalg.qr(image + 1e-12)[0].astype(np.float32)
    left, values, _ = np.linalg.svd(image, full_matrices=False)
    k = max(1, min(DIMENSIONS, int((values > 1e-6 * values[0]).sum())))
    scale = np.maximum(values[:k], 1e-30) ** -0.25
    return np.vstack([left[:, :k] * (scale / scale.max()), np.zeros((1, k))]).astype(np.float32)


def _item_passages(index: ItemIndex, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors, owners = [], []
    for j, words in enumerate(index.words):
        starts = list(range(0, max(1, len(words) - NARROW + 1), STRIDE))
        if starts[-1] + NARROW < len(words):
            starts.append(len(words) - NARROW)
        for s in starts:
            vectors.append(table[words[s : s + NARROW]].sum(0))
            owners.append(j)
    if not vectors:
        return np.zeros((0, table.shape[1]), np.float32), np.zeros(0, np.int64)
    return _unit(np.array(vectors, np.float32)), np.array(owners)


def _item_windows(index: ItemIndex) -> np.ndarray:
    """Word numbers of the item passages in the order of `_item_passages`, -1 where an item is shorter."""
    rows = []
    for words in index.words:
        starts = list(range(0, max(1, len(words) - NARROW + 1), STRIDE))
        if starts[-1] + NARROW < len(words):
            starts.append(len(words) - NARROW)
        rows += [np.pad(words[s : s + NARROW], (0, NARROW - len(words[s : s + NARROW])), constant_values=-1) for s in starts]
    return np.array(rows, np.int32).reshape(-1, NARROW)


def _common_in_order(texts: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of `texts` with the same row of `passages`, bit by bit for all rows at once."""
    full = np.int64((1 << NARROW) - 1)
    state = np.full(len(texts), full, np.int64)
    bits = np.int64(1) << np.arange(NARROW, dtype=np.int64)
    for k in range(texts.shape[1]):
        met = state & ((passages == texts[:, k : k + 1]) @ bits)
        state = ((state + met) | (state - met)) & full
    return NARROW - np.bitwise_count(state).astype(np.int32)


@dataclass(frozen=True)
class Cells:
    """The item passages in cells: centroids, the members of each cell, and the least cosines of centroids and passages.

    `near` and `least` are those of all but a thousandth of planted runs, `near_run` and `least_run` those of all.
    """

    centroids: np.ndarray
    members: list[np.ndarray]
    near: float
    least: float
    near_run: float
    least_run: float

    def touched(self, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Which passages are in any pair above the limits of runs; a passage is looked at until its first one."""
        close = vectors @ self.centroids.T
        out = np.zeros(len(vectors), bool)
        for k in np.argsort(-close.max(0)) if len(vectors) else ():
            rows = np.flatnonzero((close[:, k] > self.near_run) & ~out)
            if len(rows) and len(self.members[k]):
                out[rows] = (vectors[rows] @ queries[self.members[k]].T).max(1) > self.least_run
        return out

    def candidates(self, vectors: np.ndarray, queries: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item passage, cosine) of the pairs above the limits, with `runs` those of runs; memory is bounded by one cell's share."""
        close = vectors @ self.centroids.T > (self.near_run if runs else self.near)
        out = []
        for k, own in enumerate(self.members):
            rows = np.flatnonzero(close[:, k])
            if len(rows):
                cosine = vectors[rows] @ queries[own].T
                p, q = np.nonzero(cosine > (self.least_run if runs else self.least))
                out.append((rows[p], own[q], cosine[p, q]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))


def _centroids(queries: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """About sqrt(n) centroids of the item passages by spherical k-means, and the cell of each passage."""
    k = max(1, int(np.sqrt(len(queries))))
    centroids = queries[np.random.default_rng(5).choice(len(queries), k, replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([(queries[a : a + 8192] @ centroids.T).argmax(1) for a in range(0, len(queries), 8192)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, queries)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), centroids)
    cell = np.concatenate([(queries[a : a + 8192] @ centroids.T).argmax(1) for a in range(0, len(queries), 8192)])
    return centroids.astype(np.float32), cell


Plantings = Callable[[Iterator[pd.DataFrame]], Iterator[tuple[np.ndarray, np.ndarray]]]


def _planter(coded: DataFrame, index: ItemIndex, table: np.ndarray) -> Plantings | None:
    """What workers call on their documents: vectors of passages that hold STEP words and a run of an item, and the items.

    Every block of every document gets a run, or several until every run of the items has a place: blocks are numbered
    through all documents, and runs are taken in turn.
    """
    size, flat = index.size, np.concatenate(index.words)
    lengths = np.array([len(w) for w in index.words])
    many = np.maximum(lengths - RUN + 1, 0)
    item = np.repeat(np.arange(len(lengths)), many)
    at = np.arange(many.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(many) - many), many)
    blocks = F.sum(F.ceil(F.length("words") / (4 * STEP)))
    numbers = {r.p: r.n for r in coded.groupBy(F.spark_partition_id().alias("p")).agg(blocks.alias("n")).collect()}
    total = sum(numbers.values())
    if not total or not len(at):
        return None
    first = dict(zip(sorted(numbers), itertools.accumulate((numbers[p] for p in sorted(numbers)), initial=0)))
    rounds = -(-len(at) // total)

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number = first.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                words = [w for w in map(_numbers, batch["words"].iloc[lo : lo + 512]) if len(w)]
                grid = _laid(words, size)[0] if words else np.zeros((0, STEP), np.int32)
                for a in range(0, len(grid), 8192):
                    beside = table[grid[a : a + 8192]].sum(1)
                    for k in range(rounds):
                        run = (number + a + k * total + np.arange(len(beside))) % len(at)
                        yield _unit(beside + table[flat[at[run][:, None] + np.arange(RUN)]].sum(1)), item[run]
                number += len(grid)

    return plant


def _planted(coded: DataFrame, index: ItemIndex, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All planted passages and their items, to look at those of a small table."""
    plant = _planter(coded, index, table)
    if plant is None:
        return np.zeros((0, table.shape[1]), np.float32), np.zeros(0, np.int64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vectors, wanted in plant(batches):
            yield pd.DataFrame({"v": [v.astype(np.float32).tobytes() for v in vectors], "j": wanted})

    got = coded.mapInPandas(rows, "v binary, j bigint").collect()
    return np.array([np.frombuffer(r.v, np.float32) for r in got]), np.array([r.j for r in got], np.int64)


def _low_end(counts: np.ndarray, share: float) -> float:
    """The step's beginning of the cosine that `share` of all are below."""
    rank = int(share * (counts.sum() - 1))
    return float(np.searchsorted(np.cumsum(counts), rank, "right")) / FINE - 1.0


def _index_cells(coded: DataFrame, index: ItemIndex, table: np.ndarray, queries: np.ndarray, owners: np.ndarray, most: float) -> Cells:
    """Cells with the limits from which all planted runs, or all but a thousandth, are candidates of their item.

    Workers count the cosines of all planted passages in steps of 1 / FINE; only these counts are sent.
    """
    centroids, cell = _centroids(queries)
    members = [np.flatnonzero(cell == k) for k in range(len(centroids))]
    plant = _planter(coded, index, table)
    if plant is None:
        return Cells(centroids, members, -2.0, most, -2.0, most)
    bounds = np.searchsorted(owners, np.arange(len(index.words) + 1))

    def steps(cosine: np.ndarray) -> np.ndarray:
        return np.bincount(np.clip(np.floor((cosine + 1.0) * FINE).astype(int), 0, 2 * FINE), minlength=2 * FINE + 1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 2 * FINE + 1), np.int64)
        for vectors, wanted in plant(batches):
            best, near = np.zeros(len(vectors)), np.zeros(len(vectors))
            ends = np.append(np.flatnonzero(np.diff(wanted)) + 1, len(wanted))
            for a, b in zip(np.append(0, ends[:-1]), ends):
                own = np.arange(bounds[wanted[a]], bounds[wanted[a] + 1])
                cosine = vectors[a:b] @ queries[own].T
                best[a:b] = cosine.max(1)
                near[a:b] = (vectors[a:b] * centroids[cell[own[cosine.argmax(1)]]]).sum(1)
            counts += [steps(best), steps(near)]
        held = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"step": held.astype("int32"), "best": counts[0, held], "near": counts[1, held]})

    best, near = np.zeros(2 * FINE + 1, np.int64), np.zeros(2 * FINE + 1, np.int64)
    for r in coded.mapInPandas(measure, "step int, best bigint, near bigint").groupBy("step").agg(F.sum("best").alias("best"), F.sum("near").alias("near")).collect():
        best[r.step], near[r.step] = r.best, r.near
    (near_run, near_most), (least_run, least_most) = ([_low_end(x, share) - 0.02 for share in (0.0, 0.0005)] for x in (near, best))
    return Cells(centroids, members, near_most, min(most, least_most), near_run, min(most, least_run))


def _common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        up = row.copy()
        row[1:] = np.maximum(up[1:], up[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "item_text", answer: str = "answer", min_cosine: float = MIN_COSINE, paraphrases: bool = False,
) -> DataFrame:
    """Documents that hold item text: doc_id, item_id, cosine, words (longest common subsequence), has_answer, kind.

    kind is `verbatim` for a shared run of RUN words. With `paraphrases` also `reworded`: no such run, but a candidate
    item passage whose words stand in the same order in and just beside the document passage for two thirds or more.
    Null and empty texts, items shorter than RUN words and empty tables give no rows; a document and item make one row
    however often they meet; rows repeated in `documents` are one; whole texts are searched, of any length.
    """
    index = index_items(items, item_id, item_text, answer)
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, {item_id} bigint, cosine float, words int, has_answer boolean, kind string"
    if not index.words:
        return documents.sparkSession.createDataFrame([], schema)
    coded = cut(encode_documents(documents, doc_id, text, index))
    idf = inverse_document_frequency(coded, index.size)
    table = singular_vectors(coded, idf, index.words) * idf[:, None]
    queries, owners = _item_passages(index, table)
    cells = _index_cells(coded, index, table, queries, owners, min_cosine)
    size = index.size
    windows = _item_windows(index)
    lengths = np.array([len(w) for w in index.words])
    least = np.ceil(2 * np.minimum(NARROW, lengths) / 3).astype(np.int32)
    least[lengths < RUN] = NARROW + 1

    def reworded(flat: np.ndarray, doc: np.ndarray, start: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the passages p hold enough words of the item passages q in order; half a step beside p counts too."""
        new = np.nonzero(np.append(True, doc[1:] != doc[:-1]))[0]
        which = np.searchsorted(new, p, "right") - 1
        low, high = start[new][which] * STEP, np.append(start[new[1:]] * STEP, len(flat))[which]
        out = np.zeros(len(p), bool)
        for a in range(0, len(p), 50_000):
            cut_out = slice(a, a + 50_000)
            at = start[p[cut_out]][:, None] * STEP + np.arange(-STEP // 2, WIDE + STEP // 2)
            inside = (at >= low[cut_out, None]) & (at < high[cut_out, None])
            texts = np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], size)
            out[cut_out] = _common_in_order(texts, windows[q[cut_out]]) >= least[owners[q[cut_out]]]
        return out

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.iloc[lo : lo + 512]
                kept = [(d, w) for d, w in zip(batch["d"], map(_numbers, batch["words"])) if len(w)]
                if kept:
                    yield from look([d for d, _ in kept], [w for _, w in kept])

    def look(ids: list, words: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        grid, doc, start = _laid(words, size)
        vectors = _unit(_vectors(grid, doc, start, table))
        flat = grid.ravel()
        single = _alone(doc, start, len(grid))
        found: dict[tuple[int, int], tuple] = {}
        for a in range(0, len(doc), 2048):
            block = np.arange(a, min(a + 2048, len(doc)))
            # Of the passages in pairs above the limits of runs, those that hold a run of any item.
            held = block[cells.touched(vectors[block], queries)]
            held = held[holds_run(flat, start, single, held)]
            p, q, cosine = cells.candidates(vectors[held], queries, runs=True)
            p = held[p]
            if paraphrases:
                p2, q2, cosine2 = cells.candidates(vectors[block], queries)
                both, one = np.unique(np.append(p, block[p2]) * len(queries) + np.append(q, q2), return_index=True)
                (p, q), cosine = np.divmod(both, len(queries)), np.append(cosine, cosine2)[one]
            # Runs are read for each candidate passage and item, paraphrases for each candidate pair of passages.
            item = owners[q]
            pair, at = np.unique(p * len(index.words) + item, return_inverse=True)
            run = shared_run(flat, start, single, *np.divmod(pair, len(index.words)))
            alike = reworded(flat, doc, start, p, q) & ~run[at] if paraphrases else np.zeros(len(p), bool)
            other = np.zeros(len(pair), bool)
            np.logical_or.at(other, at, alike)
            best = np.zeros(len(pair), np.float32)
            np.maximum.at(best, at, cosine)
            keep = run | other
            passage, item = np.divmod(pair[keep], len(index.words))
            for p1, j, c, exact in zip(passage, item, best[keep], run[keep]):
                d = doc[p1]
                there = words[d]
                own = start[p1] * STEP - start[np.searchsorted(doc, d)] * STEP
                near_text = there[max(0, own - WIDE) : own + 2 * WIDE]
                lcs = _common_subsequence(near_text, index.words[j])
                old = found.get((d, j))
                new = (bool(exact), lcs, float(c))
                if old is None or new > old:
                    found[d, j] = new
        rows = [
            (ids[d], int(index.ids[j]), c, lcs, _holds(words[d], index.answers[j]), "verbatim" if exact else "reworded")
            for (d, j), (exact, lcs, c) in found.items()
        ]
        yield pd.DataFrame(rows, columns=["d", "i", "cosine", "words", "has_answer", "kind"])

    def run_keys(flat: np.ndarray, start: np.ndarray, single: np.ndarray, passages: np.ndarray) -> np.ndarray:
        places = np.minimum(start[passages][:, None] * STEP + np.arange(WIDE), len(flat) - 1)
        keys = _run_hashes_of(flat[places])
        keys[single[passages], 1:] = 0  # the next block is another document's
        return keys

    def holds_run(flat: np.ndarray, start: np.ndarray, single: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Which passages hold a run of RUN words of any item."""
        if not len(passages) or not len(index.run_keys):
            return np.zeros(len(passages), bool)
        keys = run_keys(flat, start, single, passages)
        at = np.minimum(np.searchsorted(index.run_keys, keys), len(index.run_keys) - 1)
        return (index.run_keys[at] == keys).any(1)

    def shared_run(flat: np.ndarray, start: np.ndarray, single: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether a candidate passage and item share a run of RUN words."""
        hit = np.zeros(len(passage), bool)
        own, at = np.unique(passage, return_inverse=True)
        if not len(own) or not len(index.run_keys):
            return hit
        keys = run_keys(flat, start, single, own)
        left, right = np.searchsorted(index.run_keys, keys, "left"), np.searchsorted(index.run_keys, keys, "right")
        for step in range(int((right - left).max(initial=0))):
            owner = np.where(left + step < right, index.run_items[np.minimum(left + step, len(index.run_items) - 1)], -1)
            hit |= (owner[at] == item[:, None]).any(1)
        return hit

    leaks = coded.mapInPandas(search, f"d {kind}, i bigint, cosine float, words int, has_answer boolean, kind string")
    best = F.struct(F.col("kind") == "verbatim", "words", "cosine", "has_answer")
    return (
        leaks.groupBy("d", "i").agg(F.max(best).alias("m"))
        .select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "m.cosine", "m.words", "m.has_answer", F.when(F.col("m.col1"), "verbatim").otherwise("reworded").alias("kind"))
    )


def _holds(words: np.ndarray, answer: list[int]) -> bool:
    if not answer or len(answer) > len(words):
        return False
    hits = np.ones(len(words) - len(answer) + 1, bool)
    for k, w in enumerate(answer):
        hits &= words[k : len(words) - len(answer) + 1 + k] == w
    return bool(hits.any())
