"""Repairing text of scanned pages: furniture, cut words, misread characters, paragraphs.

Furniture (running heads, page numbers, scan stamps) is told from text by what repeats: over all entries short lines
are counted by their letters, and those that nearly always stand at the edge of a page are furniture, as are lines
that repeat an entry's own title or author after its first lines, with misprints allowed. Inside a `sec` a page's edge
is told from page numbers and broken sentences. A rare head counts if it repeats at edges of one entry, or if it stands
at an edge and ends in a volume number.

Misread words are rare words that a plausible change of glyphs may turn into a more frequent one. Each occurrence is
judged by itself: the odds that counts give are multiplied by those of its context, which compare the skip-gram vector
of the frequent word with the vectors of the words around. How much a likeness is worth is measured on the whole text: by
the likeness of words to the places where they stand, against that of other words. A text whose words do not depend on
their neighbours is thus judged by counts alone.

Counts, stamps and links are joined. Two tables of bounded size go to all workers: the vectors of at most MOST_WORDS
words, and as many words that need no look.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, Window, functions as F

from citeloom.operators.relational import meet
from citeloom.runtime import cut

MOST_WORDS = 200_000  # words with vectors, the most frequent ones; of others counts alone decide
RATIO = 20  # how much more frequent the right word is where the context says nothing
LEAST_RATIO = 4  # below it no context is strong enough
STRONGEST = 1.5  # largest weight of a context either way, as a logarithm: between 4 and 90 times as frequent
VECTOR = 16
PART_WORDS = 250_000  # words of a partition that skip-grams are learned in
MOST_PARTS = 10_000  # beyond it partitions grow
BINS = 20  # steps of likeness
LONG_KEY = 200  # letters from which a line's key is a hash, so that long lines cost no more than short ones
KEYS = ["entry_name", "elem", "seq"]

# Glyphs that scanners confuse, read -> printed.
GLYPHS = {
    "c": "eo", "e": "co", "é": "e", "è": "e", "ë": "e", "@": "a", "!": "il", "(": "c", "{": "c", "f": "t", "t": "f", "5": "s", "$": "s",
    "0": "o", "1": "li", "I": "l", "|": "l", "l": "it", "i": "lj", "6": "b", "9": "g", "8": "b", "3": "e", "2": "z", "h": "b", "b": "h",
    "u": "n", "n": "u", "v": "y", "y": "v", "o": "ce", "q": "g", "g": "q", "a": "o", "á": "a", "ó": "o", "í": "i", "ú": "u", "j": "i",
}
GROUPS = (
    ("rn", "m"), ("ii", "n"), ("ii", "u"), ("iii", "ni"), ("iii", "in"), ("iii", "m"), ("d", "ti"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("vv", "w"),
    ("m", "in"), ("m", "rn"), ("m", "ni"), ("tl", "d"), ("in", "m"), ("ni", "m"), ("fi", "h"), ("ri", "n"), ("lc", "k"), ("nn", "m"), ("w", "vv"), ("h", "li"),
)
SURE_CUT = "¬‐­"
_NUMBER = re.compile(r"^(?:[\[(—–-]\s*|p\.\s*|[Pp]age\s+)?[\dIOlSoBbsZ]{1,5}\s*[\])—–-]?$")
_STRAY = re.compile(r"^[^\w\s&%=+<>§/.,;:!?()\[\]\"'“”‘’–—-]$|^_$")
_FIGURE = re.compile(r"^[\dIliOoSsBbZgq]*\d[\dIliOoSsBbZgq]*$")
_DOTTED = re.compile(r"^\s*([\dIlOoSBbsZ]{1,4})\.\s*$")
# A head that names its volume: "Annals of Social Theory, Vol. 7", with misread letters.
_VOLUME = re.compile(r"^(.{6,}?)[,.;]?\s*\b(?:[Vv][o0c][l1I|it](?:ume)?|[Nn][o0]|Issue|Heft|Band|Bd|Jg|[Tt]ome)\b[.,]?\s*[\dIlOoSBbsZ]{1,4}(?:\s*\(\d{4}\))?$")
_HEAD = re.compile(r"^[^\w]?[A-Z\d].*[^.!?,;:\s¬‐­-]$")
_SENTENCE_END = re.compile(r"[.!?][\"'”’)\]]*$")
_AS_DIGITS = str.maketrans("IlOoSsBbZ", "110055882")


def _lines(content: str | None) -> list[str]:
    return (content or "").replace("\r", "").split("\n")


def _key(line: str) -> str:
    """The letters of a line; of very long ones a hash, by which they still repeat."""
    key = re.sub(r"[\W\d_]+", "", line.lower())
    return key if len(key) <= LONG_KEY else "=" + hashlib.md5(key.encode()).hexdigest()


def _is_number(line: str) -> bool:
    s = line.strip()
    return bool(_NUMBER.match(s)) and (any(c.isdigit() for c in s) or s[0] in "[(—–-p")


def _is_volume(line: str) -> bool:
    """Whether a line is a title in capitals or capitalised words and a volume number; one word may be misread."""
    found = _VOLUME.match(line.strip())
    if not found:
        return False
    words = [w for w in found[1].split() if sum(map(str.isalpha, w)) > 3]
    return bool(words) and sum(not w.lstrip("[(\"'“‘")[:1].isupper() for w in words) <= (len(words) > 2)


def _shape(line: str, key: str) -> tuple[bool, bool]:
    """Whether a line may be a head by its beginning and end, and whether it looks like the last words of a paragraph."""
    s = line.strip()
    return bool(_HEAD.match(s)) and len(key) >= 12, bool(_SENTENCE_END.search(s)) and (len(s.split()) < 3 or s[:1].islower())


def _edges(elem: str, lines: list[str], full: list[int]) -> set[int]:
    """Lines that may stand at a printed page's edge: the first and last two of a `page`; in a `sec`, which runs over
    pages, those within two lines of a page number and those inside a sentence. Its first lines may be a heading."""
    if elem != "sec":
        return {*full[:2], *full[-2:]}
    edges = set()
    for k, i in enumerate(full):
        if _is_number(lines[i]) or _DOTTED.match(lines[i]):
            edges.update(full[max(0, k - 2) : k + 3])
        elif 0 < k < len(full) - 1 and not _SENTENCE_END.search(lines[full[k - 1]].rstrip()) and lines[full[k + 1]].lstrip()[:1].islower():
            edges.add(i)
    return edges


def _word(token: str) -> str:
    """A token without the punctuation around it; case only where it is mixed, as in misreadings."""
    w = token.rstrip(" .,;:)]}\"'?’”“").lstrip("[\"'‘“")
    if w[:1] == "(" and not w[1:2].islower():
        w = w[1:]
    if not w.isascii():
        w = unicodedata.normalize("NFC", w.replace("ﬁ", "fi").replace("ﬂ", "fl").replace("ﬀ", "ff").replace("ﬃ", "ffi").replace("ﬄ", "ffl"))
    return w.lower() if w[1:].islower() or w.istitle() or w.isupper() else w


def _close(a: str, b: str, most: int = 2) -> bool:
    """Whether at most `most` edits turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    step = -(-len(b) // (most + 1))
    if not any(b[i : i + step] in a for i in range(0, len(b), step)):  # one of most + 1 pieces is untouched
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def single_pages(pages: DataFrame) -> DataFrame:
    """Each page once: (entry_name, elem, seq, content); null contents are empty."""
    return pages.groupBy(*KEYS).agg(F.coalesce(F.max("content"), F.lit("")).alias("content"))


def _page_lines(elem: str, seq: int, content: str) -> Iterator[tuple]:
    """(line_no, key, edge, last, number, top, head, ending, volume) of each line that may be furniture or an own title."""
    lines = _lines(content)
    full = [i for i, x in enumerate(lines) if x.strip()]
    top = set()
    if seq == 1:  # the first lines up to a blank one or an indented paragraph
        for i in full[:5]:
            if top and (i - 1 not in top or lines[i].startswith("   ")):
                break
            top.add(i)
        if len(top) > 4:
            top = set(full[:2])
    edges = _edges(elem, lines, full)
    ends = edges.union(full[-2:])  # the end of a sec may be a misprinted stamp, but is no evidence of one
    for i in full:
        x = lines[i]
        number = _is_number(x)
        if i in top and not number:
            yield i + 1, _key(x), False, False, False, True, False, False, False
        elif number or not x.startswith("   "):
            key = _key(x)
            dotted = _DOTTED.match(x)
            if dotted and dotted[1].translate(_AS_DIGITS).isdigit():
                yield i + 1, "#" + str(int(dotted[1].translate(_AS_DIGITS))), False, False, False, False, False, False, False
            elif number or len(key) >= 6:
                yield i + 1, key, i in edges, i in ends, number, False, *_shape(x, key), i in edges and not number and _is_volume(x)


def furniture(pages: DataFrame) -> DataFrame:
    """Rows (entry_name, elem, seq, line_no) of lines that belong to the printed page or the scan."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e, el, s, *r) for e, el, s, content in zip(batch["entry_name"], batch["elem"], batch["seq"], batch["content"]) for r in _page_lines(el, s, content)]
            yield pd.DataFrame(rows, columns=[*KEYS, "line_no", "key", "edge", "last", "number", "top", "head", "ending", "volume"])

    lines = cut(pages.mapInPandas(candidates, "entry_name string, elem string, seq int, line_no int, key string, edge boolean, last boolean, number boolean, top boolean, head boolean, ending boolean, volume boolean"))  # counted, then joined with what the counts say
    # Most lines of text are met in one entry only; two steps keep a stamp that all entries share from one task.
    counts = [F.sum("n").alias("n"), F.sum("at").alias("at"), F.max("again").alias("again"), F.sum("page_n").alias("page_n"), F.sum("page_at").alias("page_at"), F.max("ending").alias("ending")]
    at, on_page = F.sum(F.col("edge").cast("int")), F.col("elem") == "page"
    stats = lines.where("not number and not top and not startswith(key, '#')").groupBy("key", "entry_name", "elem").agg(F.count("*").alias("n"), at.alias("at"), F.when(F.min("head"), at).otherwise(0).alias("again"), F.max("ending").alias("ending"))
    stats = stats.withColumns({"page_n": F.when(on_page, F.col("n")).otherwise(0), "page_at": F.when(on_page, F.col("at")).otherwise(0)})
    stats = stats.groupBy("key", "entry_name").agg(*counts).groupBy("key").agg(*counts, F.count("*").alias("entries"), F.count_if(F.col("page_n") > 0).alias("page_entries"))
    # Either over all lines, or over those of whole pages, whose edges are certain; or a rare head, by its return at edges of one entry.
    often = "(entries >= 3 and n >= 5 and at >= 0.6 * n and not ending) or (page_entries >= 3 and page_n >= 5 and page_at >= 0.6 * page_n)"
    known = stats.where(f"{often} or (again >= 2 and at >= 0.6 * n)").select("key", F.lit(True).alias("known"))
    marked = cut(lines.join(known, "key", "left"))
    # Misprinted stamps whose entry has no clean one: an edge line that shares its beginning or end with a known key.
    ends = F.explode(F.array(F.concat(F.lit("^"), F.substring("key", 1, 8)), F.concat(F.lit("$"), F.expr("right(key, 8)"))))
    strange = marked.where("known is null and last and not number and not top and length(key) >= 12").select("key").distinct().select("key", ends.alias("end"))
    pairs = meet(strange, known.where("length(key) >= 12").select(F.col("key").alias("other"), ends.alias("end")), ["end"]).select("key", "other").distinct()

    def misprinted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[_close(a, b) for a, b in zip(batch["key"], batch["other"])], ["key"]]

    near_known = pairs.mapInPandas(misprinted, "key string").distinct()
    stamped = marked.where("known is null and last and not number and not top").join(near_known, "key", "left_semi").select(*KEYS, "line_no")
    own = marked.where("top or known or volume").groupBy("entry_name").agg(
        F.array_sort(F.collect_set(F.when(F.col("top"), F.struct("elem", "line_no", "key")))).alias("tops"),
        F.collect_set(F.when((F.coalesce("known", F.lit(False)) | F.col("volume")) & ~F.col("top"), F.col("key"))).alias("stamps"),
    )
    # A number with a full stop is a page number if the entry has its neighbour too; a year that ends a sentence is not.
    dotted = marked.where("startswith(key, '#')").withColumn("v", F.substring("key", 2, 9).cast("int"))
    beside = dotted.select("entry_name", F.explode(F.array(F.col("v") - 1, F.col("v") + 1)).alias("v")).distinct()
    paged = dotted.join(beside, ["entry_name", "v"], "left_semi").select(*KEYS, "line_no")
    sure = marked.where("number or ((known or volume) and not top)").select(*KEYS, "line_no")

    def like_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for e, el, s, content, tops, stamps in zip(*(batch[k] for k in (*KEYS, "content", "tops", "stamps"))):
                heads = [t["key"] for t in tops]
                whole = "".join(heads)
                near = list(dict.fromkeys([*heads, *stamps]))
                for line_no, key, _, _, number, top, *_ in _page_lines(el, s, content):
                    if number or top or key.startswith("#"):
                        continue
                    if key in near or (len(key) >= 8 and whole.startswith(key)) or (len(key) >= 10 and (any(_close(key, k) for k in near) or _close(key, whole[: len(key)]))):
                        rows.append((e, el, s, line_no))
            yield pd.DataFrame(rows, columns=[*KEYS, "line_no"])

    schema = "entry_name string, elem string, seq int, line_no int"
    repeated = pages.join(own, "entry_name").select(*KEYS, "content", "tops", "stamps").mapInPandas(like_own, schema)
    return sure.unionByName(paged).unionByName(stamped).unionByName(repeated)


def _flow(content: str, furniture_lines: set[int]) -> list[tuple[int, str]]:
    """(line number, line) of the lines of text."""
    return [(i, x) for i, x in enumerate(_lines(content), 1) if x.strip() and i not in furniture_lines]


def _cut_end(line: str) -> tuple[str, str] | None:
    """(part before, sign) if a line ends in a sign of cutting after a letter."""
    s = line.rstrip()
    if len(s) > 1 and (s[-1] == "-" or s[-1] in SURE_CUT) and s[-2].isalpha():
        return s.split()[-1][:-1], s[-1]
    return None


def _tokens(text: list[tuple[int, str]], first_after: str | None) -> Iterator[tuple[int, str, str, tuple[str, str, str] | None]]:
    """(line, token, word, cut): words cut at a line's end are one token, `cut` its parts and sign."""
    carry = None
    for no, line in text:
        parts = line.split()
        end = _cut_end(line)
        if carry is not None and parts:
            head_no, head, sign = carry
            tail = parts.pop(0)
            yield head_no, head + tail, _word(head + tail), (head, tail, sign)
            carry = None
        if end is not None and parts:
            parts.pop()
            carry = (no, *end)
        for p in parts:
            yield no, p, _word(p), None
    if carry is not None:
        no, head, sign = carry
        if first_after:
            yield no, head + first_after, _word(head + first_after), (head, first_after, sign)
        else:
            yield no, head, _word(head), (head, "", sign)


def word_counts(flows: DataFrame) -> DataFrame:
    """(word, n) over all text; words that a doubtful cut would make are listed but not counted, so n may be 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for content, skip in zip(batch["content"], batch["skip"]):
                for _, _, w, c in _tokens(_flow(content, set(skip)), None):
                    seen[w] += int(c is None or (c[2] in SURE_CUT and bool(c[1])))
            if len(seen) > 500_000:  # a bounded table; the rest is added up after the shuffle
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return flows.mapInPandas(count, "word string, n bigint").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _changes(word: str) -> Iterator[str]:
    """Words that a scanner may have read as `word`."""
    for i, c in enumerate(word):
        for good in GLYPHS.get(c, ""):
            yield word[:i] + good + word[i + 1 :]
    for bad, good in GROUPS:
        at = word.find(bad)
        while at >= 0:
            yield word[:at] + good + word[at + len(bad) :]
            at = word.find(bad, at + 1)


def glyph_links(counts: DataFrame) -> DataFrame:
    """(word, right, n, n_right): rare words and the more frequent words that they may be misreadings of."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (w, max(n, 1), r.lower()) for w, n in zip(batch["word"], batch["n"]) if len(w) > 2 and sum(map(str.isalpha, w)) > 1
                for r in {x for one in {*_changes(w)} for x in ((one,) if one.islower() else (one, *_changes(one)))}
            ]
            yield pd.DataFrame(rows, columns=["word", "n", "right"])

    rare = counts.mapInPandas(spread, "word string, n bigint, right string")
    right = counts.where(f"n >= {RATIO // 2}").select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    return rare.join(right, "right").where(f"n_right >= {LEAST_RATIO} * n and word <> right").select("word", "right", "n", "n_right").distinct()


def _sentences(flows: DataFrame, known: Broadcast) -> DataFrame:
    """(words): the words with vectors of each page in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_words = known.value
        for batch in batches:
            yield pd.DataFrame({"words": [[w for _, _, w, _ in _tokens(_flow(c, set(s)), None) if w in known_words] for c, s in zip(batch["content"], batch["skip"])]})

    return flows.mapInPandas(run, "words array<string>")


@dataclass(frozen=True)
class Contexts:
    """Skip-gram vectors of frequent words, and by steps of likeness how much it speaks for a word (log odds)."""

    place: dict[str, int]
    vectors: np.ndarray
    worth: list[float]

    def around(self, words: list[str], i: int) -> np.ndarray | None:
        """Mean vector of the words beside place i, as a unit vector; None where none of them has a vector."""
        near = [p for p in map(self.place.get, [*words[max(0, i - 3) : i], *words[i + 1 : i + 4]]) if p is not None]
        if not near:
            return None
        mean = self.vectors[near].mean(0)
        return mean / max(float(np.linalg.norm(mean)), 1e-9)


def _step(likeness: np.ndarray) -> np.ndarray:
    return np.clip(((likeness + 1.0) * (BINS / 2)).astype(int), 0, BINS - 1)


def _likeness_counts(sentences: DataFrame, contexts: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """By steps of likeness: how many places of the text hold a word so like them, and how many would with words dealt anew.

    Every place counts, once with its own word and once with another: places are numbered through the text and words
    dealt out in strides without a common divisor with their number, so that each word comes exactly as often as it is.
    """
    place, vectors = contexts.place, contexts.vectors
    numbers = {r.p: r.n for r in sentences.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("words")).alias("n")).collect()}
    often = np.zeros(len(place), np.int64)
    for r in sentences.select(F.explode("words").alias("word")).groupBy("word").count().toLocalIterator():  # at most MOST_WORDS
        often[place[r.word]] = r["count"]
    ends = np.cumsum(often)
    total = int(ends[-1])
    stride = max(1, round(total * 0.6180339887498949))
    while math.gcd(stride, total) > 1:
        stride += 1
    first = dict(zip(sorted(numbers), itertools.accumulate((numbers[p] for p in sorted(numbers)), initial=0)))
    shared = sentences.sparkSession.sparkContext.broadcast((place, vectors, ends, first))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, vectors, ends, first = shared.value
        counts, at = np.zeros((2, BINS), np.int64), first.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            lengths = np.array([len(ws) for ws in batch["words"]], np.int64)
            words = np.fromiter((place[w] for ws in batch["words"] for w in ws), np.int64, int(lengths.sum()))
            high = np.repeat(np.cumsum(lengths), lengths)
            low = high - np.repeat(lengths, lengths)
            for a in range(0, len(words), 1 << 15):  # bounded memory, however long pages are
                i = np.arange(a, min(a + (1 << 15), len(words)))
                mean, near = np.zeros((len(i), vectors.shape[1]), np.float32), np.zeros(len(i), np.float32)
                for k in (-3, -2, -1, 1, 2, 3):
                    beside = (i + k >= low[i]) & (i + k < high[i])
                    mean += vectors[words[np.where(beside, i + k, 0)]] * beside[:, None]
                    near += beside
                mean /= np.maximum(near, 1)[:, None]
                mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
                dealt = np.searchsorted(ends, ((at + a) * stride % total + (i - a) * stride) % total, "right")
                for side, w in enumerate((words[i], dealt)):
                    likeness = (mean * vectors[w]).sum(1)[near > 0]
                    counts[side] += np.bincount(_step(likeness), minlength=BINS)
            at += len(words)
        yield pd.DataFrame({"step": np.arange(BINS, dtype=np.int32), "own": counts[0], "other": counts[1]})

    got = sentences.mapInPandas(measure, "step int, own bigint, other bigint").groupBy("step").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    own, other = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in got.collect():
        own[r.step], other[r.step] = r.own, r.other
    return own, other


def learn_contexts(flows: DataFrame, counts: DataFrame, total: int) -> Contexts | None:
    """Skip-gram vectors from the whole text in as many partitions as it has words for, and the worth of likeness.

    The worth is measured on every place of the text: how often a word is so like its place, by how often a word
    drawn by its frequency is.
    """
    least = max(5, -(-total // MOST_WORDS))
    frequent = counts.where(F.col("n") >= least)
    words = frozenset(r.word for r in frequent.select("word").collect())  # at most MOST_WORDS
    if not words:
        return None
    known = flows.sparkSession.sparkContext.broadcast(words)
    sentences = cut(_sentences(flows, known))
    parts = int(min(MOST_PARTS, max(4, total // PART_WORDS)))
    model = Word2Vec(vectorSize=VECTOR, minCount=0, windowSize=3, maxIter=1, numPartitions=parts, seed=5, inputCol="words", outputCol="v").fit(sentences)
    rows = sorted((r.word, r.vector.toArray()) for r in model.getVectors().collect())  # at most MOST_WORDS
    vectors = np.array([v / max(np.linalg.norm(v), 1e-9) for _, v in rows], np.float32)
    found = Contexts({w: k for k, (w, _) in enumerate(rows)}, vectors, [0.0] * BINS)
    own, other = _likeness_counts(sentences, found)
    # Steps that few words reach say little: both sides are smoothed by their neighbours.
    near = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
    own, other = np.convolve(own + 1.0, near, "same") + 20.0, np.convolve(other + 1.0, near, "same") + 20.0
    worth = np.clip(np.log(own / own.sum()) - np.log(other / other.sum()), -STRONGEST, STRONGEST)
    return Contexts(found.place, vectors, [float(x) for x in worth])


def _flows(pages: DataFrame) -> DataFrame:
    """Pages with the numbers of their furniture lines (`skip`) and the first token of the next page (`after`)."""
    skip = furniture(pages).groupBy(*KEYS).agg(F.collect_set("line_no").alias("skip"))
    flows = cut(pages.join(skip, KEYS, "left").withColumn("skip", F.coalesce("skip", F.expr("array()").cast("array<int>"))))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [next((x for i, x in enumerate(_lines(c), 1) if x.strip() and i not in skipped), None) for c, skipped in zip(batch["content"], map(set, batch["skip"]))]
            yield batch[KEYS].assign(after=[t.split()[0] if t else None for t in text])

    heads = flows.mapInPandas(first, "entry_name string, elem string, seq int, after string").withColumn("seq", F.col("seq") - 1)
    return cut(flows.join(heads, KEYS, "left"))


def _in_context(found: DataFrame, links: DataFrame, contexts: Contexts | None) -> DataFrame:
    """The occurrences (`word`, `context` and others) that are misread, each with its likeliest `right` word."""
    rows = found.withColumn("_o", F.monotonically_increasing_id()).join(links, "word")
    if contexts is None:
        worth = F.lit(0.0)
    else:
        vectors = found.sparkSession.createDataFrame(
            pd.DataFrame({"right": list(contexts.place), "vector": [v.tolist() for v in contexts.vectors]}), "right string, vector array<float>"
        )
        rows = rows.join(F.broadcast(vectors), "right", "left")  # at most MOST_WORDS rows of VECTOR numbers
        likeness = F.aggregate(F.zip_with("context", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        step = F.least(F.greatest(F.floor((likeness + 1.0) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
        worth = F.coalesce(F.element_at(F.array(*[F.lit(x) for x in contexts.worth]), (step + 1).cast("int")), F.lit(0.0))
    odds = F.log(F.col("n_right") / F.col("n")) - F.log(F.lit(float(RATIO))) + worth
    kept = rows.withColumn("_odds", odds).where("_odds >= 0")
    others = [c for c in found.columns if c != "context"]
    best = kept.groupBy("_o").agg(F.max_by(F.struct(*others, "right"), F.struct("_odds", "right")).alias("r"))
    return best.select("r.*")


def find_flaws(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flaws, flows, corrections).

    flaws: entry_name, elem, seq, line_no, flaw with flaw `furniture`, `hyphen` or `misread`; a furniture line has no
    other flaw. corrections: entry_name, elem, seq, line_no, token, right. Pages listed twice count once; null and
    empty contents have no lines; lines end at LF, a CR is ignored, blank lines are counted; pages and words of any
    length are read whole; an empty table gives no rows.
    """
    flows = _flows(single_pages(pages))
    counts = cut(word_counts(flows))
    links = cut(glyph_links(counts))
    total = int(counts.agg(F.sum("n")).head()[0] or 0)
    contexts = learn_contexts(flows, counts, total) if links.head(1) else None
    model = flows.sparkSession.sparkContext.broadcast(contexts)
    # Words that are frequent and no misreading need no look; any other word is looked up in the links.
    sound = counts.where(F.col("n") >= max(5, -(-total // MOST_WORDS))).join(links.select("word").distinct(), "word", "left_anti")
    skip_words = flows.sparkSession.sparkContext.broadcast(frozenset(r.word for r in sound.select("word").collect()))  # at most MOST_WORDS
    # Where the linked words are few, workers get them and pass on no other rows; else the join below drops the others.
    linked = links.select("word").distinct().limit(MOST_WORDS + 1).collect()
    wanted_words = flows.sparkSession.sparkContext.broadcast(frozenset(r.word for r in linked) if len(linked) <= MOST_WORDS else None)

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, known, wanted = skip_words.value, model.value, wanted_words.value

        def doubtful(word: str) -> bool:
            return word in wanted if wanted is not None else bool(word) and word not in frequent

        def context(words: list[str], i: int) -> list[float] | None:
            mean = known.around(words, i) if known is not None else None
            return None if mean is None else mean.tolist()

        for batch in batches:
            rows = []
            for e, el, s, content, skip, after in zip(*(batch[k] for k in (*KEYS, "content", "skip", "after"))):
                skipped = set(skip)
                rows += [(e, el, s, n, "furniture", "", "", "", "", None) for n in skipped]
                text = _flow(content, skipped)
                next_line = {no: text[k + 1][0] for k, (no, _) in enumerate(text[:-1])}
                tokens = list(_tokens(text, after))
                words = [t[2] for t in tokens]
                for k, (no, token, w, parts) in enumerate(tokens):
                    at = no
                    if parts is not None:
                        head, tail, sign = parts
                        if sign in SURE_CUT:
                            rows.append((e, el, s, no, "hyphen", token, "", "", "", None))
                        elif tail:
                            rows.append((e, el, s, no, "cut", token, w, _word(f"{head}-{tail}"), _word(tail), None))
                        # A misread character stands in the part of the line that holds it.
                        if tail and doubtful(w):
                            rows.append((e, el, s, no, "part", token, w, head, str(next_line.get(no, 0)), context(words, k)))
                        continue
                    if _STRAY.match(token):
                        rows.append((e, el, s, at, "misread", token, "", "", "", None))
                    elif _FIGURE.match(figure := w.lstrip("(")) and not figure.isdigit() and not re.match(r"^\d{4}[a-z]$", figure) and len(figure) > 1:
                        rows.append((e, el, s, at, "misread", token, "", "", "", None))
                    elif doubtful(w):
                        rows.append((e, el, s, at, "word", token, w, "", "", context(words, k)))
            yield pd.DataFrame(rows, columns=[*KEYS, "line_no", "kind", "token", "word", "other", "tail", "context"])

    schema = "entry_name string, elem string, seq int, line_no int, kind string, token string, word string, other string, tail string, context array<float>"
    found = cut(flows.mapInPandas(suspects, schema))
    place = [*KEYS, "line_no"]
    simple = found.where("kind in ('furniture', 'hyphen', 'misread')").select(*place, F.col("kind").alias("flaw"))
    n = counts.select(F.col("word").alias("w"), "n")
    cuts = (
        found.where("kind = 'cut'")
        .join(n.select(F.col("w").alias("word"), F.col("n").alias("n_one")), "word", "left")
        .join(n.select(F.col("w").alias("other"), F.col("n").alias("n_two")), "other", "left")
        .withColumn("n_one", F.coalesce("n_one", F.lit(0))).withColumn("n_two", F.coalesce("n_two", F.lit(0)))
    )
    hyphens = cuts.where("n_one >= n_two").select(*place, F.lit("hyphen").alias("flaw"))
    judged = _in_context(found.where("kind in ('word', 'part')"), links, contexts)
    words = judged.where("kind = 'word'")
    # In a cut word the misread glyph is where head or tail differ from the right word.
    halves = judged.where("kind = 'part'")
    in_head = ~F.startswith(F.col("right"), F.lower("other"))
    parts = halves.select("entry_name", "elem", "seq", F.when(in_head, F.col("line_no")).otherwise(F.col("tail").try_cast("int")).alias("line_no")).where("line_no > 0")
    flaws = (
        simple.unionByName(hyphens).unionByName(words.select(*place, F.lit("misread").alias("flaw")))
        .unionByName(parts.select(*place, F.lit("misread").alias("flaw"))).distinct()
    )
    corrections = words.select(*place, "token", "word", "right").unionByName(halves.select(*place, "token", "word", "right"))
    return flaws, flows, corrections


def paragraphs(pages: DataFrame) -> DataFrame:
    """Continuous paragraphs: entry_name, elem, par_no, text; without furniture, cut words joined, words corrected.

    A paragraph ends at a blank line or before an indented line, not at a page's end. Stray signs are dropped.
    """
    flaws, flows, corrections = find_flaws(pages)
    joins = flaws.where("flaw = 'hyphen'").groupBy(*KEYS).agg(F.collect_set("line_no").alias("joins"))
    # Each line has its own corrections: the same letters may be two words in two places.
    fixes = corrections.groupBy(*KEYS, "line_no", "word").agg(F.max("right").alias("right")).groupBy(*KEYS).agg(F.collect_list(F.struct("line_no", "word", "right")).alias("fixes"))
    ready = flows.join(joins, KEYS, "left").join(fixes, KEYS, "left")

    def fix(token: str, known: dict[str, str]) -> str:
        w = _word(token)
        right = known.get(w)
        if right is None:
            return token
        body = token.rstrip(" .,;:)]}\"'?’”“")
        tail = token[len(body) :]
        right = right.capitalize() if token[:1].isupper() and not token[:2].isupper() else right
        return right + tail

    def reflow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for e, el, s, content, skip, joined, fixes in zip(*(batch[k] for k in (*KEYS, "content", "skip", "joins", "fixes"))):
                skipped, glue = set(skip), set(joined) if joined is not None else set()
                known: dict[int, dict[str, str]] = {}
                for f in fixes if fixes is not None else ():
                    known.setdefault(f["line_no"], {})[f["word"]] = f["right"]
                pars, open_par, blank, goes_on = [], False, False, False
                for i, line in enumerate(_lines(content), 1):
                    if i in skipped:
                        continue
                    if not line.strip():
                        blank = True
                        continue
                    words = line.split()
                    cut_here = i in glue or _cut_end(line) is not None
                    if i in glue:
                        words[-1] = words[-1][:-1]
                    first, last = int(goes_on), len(words) - int(cut_here)
                    words[first:last] = [fix(t, known.get(i, {})) for t in words[first:last] if not _STRAY.match(t)]
                    if cut_here:  # the whole word is corrected when its other part has come
                        words[-1] = ("" if goes_on and len(words) == 1 else f"\u0002{i}\u0003") + words[-1] + "\u0001"
                    text, goes_on = " ".join(words), cut_here
                    if open_par and not blank and not line.startswith("   "):
                        pars[-1][1] += text if pars[-1][1].endswith("\u0001") else " " + text
                    else:
                        pars.append([bool(pars) or blank or line.startswith("   ") or (s == 1), text])
                    open_par, blank = True, False
                for k, (new, text) in enumerate(pars):
                    end = text.endswith("\u0001")
                    words = []
                    for t in text.replace("\u0001", "").split():
                        if t[0] == "\u0002":
                            no, _, t = t[1:].partition("\u0003")
                            t = fix(t, known.get(int(no), {}))
                        words.append(t)
                    rows.append((e, el, s, k, new or k > 0, " ".join(words) + ("\u0001" if end else "")))
            yield pd.DataFrame(rows, columns=[*KEYS, "k", "new", "text"])

    bits = ready.mapInPandas(reflow, "entry_name string, elem string, seq int, k int, new boolean, text string")
    order = Window.partitionBy("entry_name", "elem").orderBy("seq", "k")
    numbered = bits.withColumn("par_no", F.sum(F.col("new").cast("int")).over(order).cast("int"))
    whole = numbered.groupBy("entry_name", "elem", "par_no").agg(F.array_sort(F.collect_list(F.struct("seq", "k", "text"))).alias("b"))
    text = F.replace(F.replace(F.array_join(F.col("b.text"), " "), F.lit("\u0001 "), F.lit("")), F.lit("\u0001"), F.lit(""))
    return whole.select("entry_name", "elem", "par_no", text.alias("text"))
