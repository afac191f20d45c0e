"""Items that appear together: exact pair counts and how far they exceed chance.

Counting is exact. Only items that can belong to a wanted pair are paired: a pair met in `min_count` baskets needs
items met in as many, and a pair of lift `min_lift` needs items met in at most N / min_lift baskets. The few items
above that bound (at most min_lift times the mean basket size) are taken out before anything is shuffled by item.
Large baskets are cut into blocks whose pairings are separate tasks.

Chance is a bipartite configuration model fitted to the degrees of all items and baskets: an item and a basket meet
with probability xy / (1 + xy). It depends on degrees only, so it is fitted on degree classes, whose number does not
grow with the data. The number of baskets that two items share is then Poisson-binomial; its upper tail is the
p-value, and Benjamini-Hochberg control over all pairs of countable items marks the surprising ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from citeloom.runtime import cut

EXACT = 2000  # shared baskets up to which tails are summed term by term
BLOCK = 256  # items of one basket that are paired in one step


def _degree_class(n: Column) -> Column:
    """Degrees up to 256 are classes of their own, larger ones fall into 64 classes an octave."""
    return F.when(n <= 256, n.cast("int")).otherwise((F.log2(n.cast("double")) * 64).cast("int") - 256)


@dataclass(frozen=True)
class ConfigurationModel:
    """Meeting probabilities by degree class: `p[i, k]` of item class i and basket class k with `baskets[k]` baskets."""

    item_classes: dict[int, int]
    baskets: np.ndarray
    p: np.ndarray

    @staticmethod
    def fit(items: list[tuple[int, float, int]], baskets: list[tuple[int, float, int]], most: int = 100_000) -> ConfigurationModel:
        """Fit to (class, mean degree, count) lists by fixed-point iteration on the degree equations, to the end.

        It ends where nothing changes or the expected degrees of all classes are met to a millionth, and fails where
        they are not met to a thousandth.
        """
        k_i, c_i = (np.array([r[j] for r in items], float) for j in (1, 2))
        k_b, c_b = (np.array([r[j] for r in baskets], float) for j in (1, 2))
        p, free_i, free_b = np.zeros((len(k_i), len(k_b))), np.ones(len(k_i), bool), np.ones(len(k_b), bool)
        left_i, left_b = k_i.copy(), k_b.copy()
        while True:  # what meets all that is left meets it for certain, and the rest is fitted without it
            sure_i = free_i & (left_i >= c_b[free_b].sum() - 1e-9)
            sure_b = free_b & (left_b >= c_i[free_i].sum() - 1e-9)
            if sure_i.any():
                p[np.ix_(sure_i, free_b)] = 1.0
                left_b = left_b - c_i[sure_i].sum()
                free_i &= ~sure_i
            elif sure_b.any():
                p[np.ix_(free_i, sure_b)] = 1.0
                left_i = left_i - c_b[sure_b].sum()
                free_b &= ~sure_b
            else:
                break
        free_i &= left_i > 1e-9
        free_b &= left_b > 1e-9
        ki, ci, kb, cb = left_i[free_i], c_i[free_i], left_b[free_b], c_b[free_b]
        edges = max(float(ki @ ci), 1.0)
        y, x = ki / np.sqrt(edges), kb / np.sqrt(edges)
        q = np.zeros((len(ki), len(kb)))
        for step in range(most if len(ki) and len(kb) else 0):
            old = x
            y = ki / np.maximum((cb * x / (1.0 + np.outer(y, x))).sum(1), 1e-300)
            x = kb / np.maximum((ci[:, None] * y[:, None] / (1.0 + np.outer(y, x))).sum(0), 1e-300)
            still = np.allclose(old, x, rtol=1e-9, atol=0.0)
            if still or step % 50 == 49 or step == most - 1:
                q = np.outer(y, x)
                q /= 1.0 + q
                off = max(np.abs(q @ cb / ki - 1.0).max(), np.abs(ci @ q / kb - 1.0).max())
                if still or off < 1e-6:
                    break
                if step == most - 1 and off > 1e-3:
                    raise ValueError(f"the null model is off by {off:.1e} of a degree after {most} rounds")
        p[np.ix_(free_i, free_b)] = q
        return ConfigurationModel({r[0]: j for j, r in enumerate(items)}, c_b, p)

    def tail(self, class_a: int, class_b: int, n: int) -> tuple[float, float]:
        """Expected number of shared baskets and the chance of at least n."""
        q = self.p[self.item_classes[class_a]] * self.p[self.item_classes[class_b]]
        mean = float(self.baskets @ q)
        return mean, poisson_binomial_tail(q, self.baskets, n, mean)


def poisson_binomial_tail(q: np.ndarray, times: np.ndarray, n: int, mean: float | None = None) -> float:
    """P(X >= n) where X sums `times[k]` Bernoulli trials of chance q[k].

    Exact but for terms below 1e-12 of the sum; above EXACT trials that succeed by the saddlepoint formula, whose
    relative error falls with their number and is below a thousandth there.
    """
    mean = float(times @ q) if mean is None else mean
    if n <= 0:
        return 1.0
    if n > times.sum():
        return 0.0
    sure = q >= 1.0 - 1e-12
    n -= int(times[sure].sum())
    q, times = q[~sure], times[~sure]
    if n <= 0:
        return 1.0
    mean = float(times @ q)
    if max(n, mean) > EXACT:
        return _saddlepoint_tail(q, times, n, mean)
    far = int(n + 40 + 2 * mean) if n > mean else n - 1
    far = min(far, int(times.sum()))
    # Coefficients of prod (1 - q + q z)^times: a binomial per class, multiplied as far as needed.
    poly = np.array([1.0])
    with np.errstate(divide="ignore", under="ignore"):
        for chance, m in zip(q, times):
            if chance <= 0.0:
                continue
            top = int(min(m, far))
            steps = np.arange(1, top + 1)
            logs = np.cumsum(np.log((m - steps + 1) / steps) + np.log(chance / (1.0 - chance))) + m * np.log1p(-chance)
            own = np.exp(np.concatenate([[m * np.log1p(-chance)], logs]))
            poly = np.convolve(poly, own)[: far + 1]
    if n > mean:
        return float(min(1.0, poly[n:].sum()))
    return float(min(1.0, max(0.0, 1.0 - poly[:n].sum())))


def _saddlepoint_tail(q: np.ndarray, times: np.ndarray, n: int, mean: float) -> float:
    """Lugannani-Rice tail with the correction for whole numbers."""
    if n >= times.sum():
        return float(np.exp(times @ np.log(np.maximum(q, 1e-300)))) if n == times.sum() else 0.0
    low, high = -700.0, 700.0
    for _ in range(200):  # the tilt at which n is the mean
        s = (low + high) / 2
        tilted = q / (q + (1.0 - q) * np.exp(-s))
        low, high = (s, high) if times @ tilted < n else (low, s)
    spread = float(times @ (tilted * (1.0 - tilted)))
    if abs(s) < 1e-6 or spread <= 0.0:
        return 0.5
    cumulant = float(times @ np.log1p(q * np.expm1(s)))
    w = np.sign(s) * math.sqrt(max(2.0 * (s * n - cumulant), 0.0))
    u = (1.0 - math.exp(-s)) * math.sqrt(spread)
    density = math.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    return float(min(1.0, max(0.0, math.erfc(w / math.sqrt(2)) / 2 + density * (1.0 / u - 1.0 / w))))


def _classes(degrees: DataFrame) -> list[tuple[int, float, int]]:
    rows = degrees.groupBy(_degree_class(F.col("n")).alias("c")).agg(F.avg("n").alias("mean"), F.count("*").alias("k")).collect()
    return sorted((r.c, r.mean, r.k) for r in rows)  # at most 256 + 64 a doubling


def cooccurrences(
    df: DataFrame, basket: str, item: str, min_count: int = 5, min_lift: float | None = None, fdr: float = 0.05
) -> DataFrame:
    """Pairs of items met together in at least `min_count` baskets.

    Columns item_a < item_b, n_ab, n_a, n_b, n_baskets, lift, expected, p_value, surprising. All counts are of
    distinct baskets, so repeated rows change nothing. Rows with a null basket or item are left out and baskets of
    nulls only are not counted. With `min_lift` only pairs of that lift or more are returned; they are judged as among
    all pairs of items met min_count times, and as fewer count as found, `surprising` can only be stricter. An empty
    table gives no rows. Other columns of `df` are ignored.
    """
    pairs = cut(df.select(F.col(basket).alias("b"), F.col(item).alias("i")).where("b is not null and i is not null").distinct())
    sizes = pairs.groupBy("b").agg(F.count("*").alias("n"))
    degrees = cut(pairs.groupBy("i").agg(F.count("*").alias("n")))
    basket_classes, item_classes = _classes(sizes), _classes(degrees)
    n_baskets = sum(k for _, _, k in basket_classes)
    kept = F.col("n") >= min_count
    rows = pairs
    if min_lift is not None:
        kept &= F.col("n") * min_lift <= n_baskets
        # Items met in more than N / lift baskets number at most lift times the mean basket size.
        rows = pairs.join(F.broadcast(degrees.where(F.col("n") * min_lift > n_baskets).select("i")), "i", "left_anti")
    items = cut(degrees.where(kept).withColumn("id", F.monotonically_increasing_id()))
    n_items = degrees.where(F.col("n") >= min_count).count()  # the family of tests does not change with `min_lift`
    rows = rows.join(items.select("i", "id"), "i").select("b", "id")

    blocks = rows.groupBy("b").agg(F.count("*").alias("size")).where("size > 1").select("b", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    placed = rows.join(blocks, "b").withColumn("blk", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("id"), F.col("nb"))).otherwise(0).cast("int"))
    lists = placed.groupBy("b", "nb", "blk").agg(F.collect_list("id").alias("ids"))
    small = lists.where("nb = 1").select(F.col("ids").alias("left"), F.col("ids").alias("right"))
    meeting = lists.where("nb > 1").select("b", "blk", "ids", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("to"))
    meeting = meeting.groupBy("b", F.least("blk", "to").alias("one"), F.greatest("blk", "to").alias("two")).agg(
        F.min_by("ids", "blk").alias("left"), F.max_by("ids", "blk").alias("right"), F.count("*").alias("k")
    ).where("k = 2 or one = two")
    within = small.unionByName(meeting.where("one = two").select("left", "right")).select(F.explode("left").alias("x"), "right")
    within = within.select("x", F.explode(F.filter("right", lambda v: v > F.col("x"))).alias("y"))
    across = meeting.where("one < two").select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y"))
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    counts = within.unionByName(across).groupBy("x", "y").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)

    def side(name: str) -> DataFrame:
        return items.select(F.col("id").alias(name), F.col("i").alias(f"i{name}"), F.col("n").alias(f"n{name}"))

    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("nx") * F.col("ny"))
    found = counts.join(side("x"), "x").join(side("y"), "y").withColumn("lift", lift)
    if min_lift is not None:
        found = found.where(F.col("n_ab") * F.lit(n_baskets) >= F.lit(min_lift) * F.col("nx") * F.col("ny"))
    low, high = F.least(_degree_class(F.col("nx")), _degree_class(F.col("ny"))), F.greatest(_degree_class(F.col("nx")), _degree_class(F.col("ny")))
    found = cut(found.withColumn("cx", low).withColumn("cy", high))
    model = ConfigurationModel.fit(item_classes, basket_classes) if found.head(1) else None

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.tail(a, b, n) for a, b, n in zip(batch["cx"], batch["cy"], batch["n_ab"])]
            yield batch.assign(expected=[o[0] for o in out], p_value=[o[1] for o in out])

    kinds = found.groupBy("cx", "cy", "n_ab").agg(F.count("*").alias("k"))
    kinds = cut(kinds.mapInPandas(tails, "cx int, cy int, n_ab bigint, k bigint, expected double, p_value double"))
    bound = _benjamini_hochberg(kinds, n_items * (n_items - 1) / 2, fdr)
    full = found.join(kinds.drop("k"), ["cx", "cy", "n_ab"])
    swap = F.col("ix") > F.col("iy")
    return full.select(
        F.when(swap, F.col("iy")).otherwise(F.col("ix")).alias("item_a"), F.when(swap, F.col("ix")).otherwise(F.col("iy")).alias("item_b"),
        "n_ab", F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("n_a"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("n_b"),
        F.lit(n_baskets).cast("bigint").alias("n_baskets"), "lift", "expected", "p_value", (F.col("p_value") <= bound).alias("surprising"),
    )


def _benjamini_hochberg(kinds: DataFrame, tests: float, fdr: float) -> float:
    """The largest p with p <= fdr * (pairs up to p) / tests.

    Steps of p by a fiftieth of an octave, few whatever the data, tell the highest step that can hold it; inside that
    step it is reached from above by counting again, each time with fewer pairs.
    """
    step = F.when(F.col("p_value") > 0.0, F.ceil(F.log2("p_value") * 50)).otherwise(-60_000).cast("int")
    rows = sorted((r.s, r.k) for r in kinds.groupBy(step.alias("s")).agg(F.sum("k").alias("k")).collect())
    below, bound = 0, 0.0
    for s, k in rows:
        below += k
        low, high = (2.0 ** ((s - 1) / 50), 2.0 ** (s / 50)) if s > -60_000 else (0.0, 0.0)
        if low <= fdr * below / max(tests, 1.0):
            bound = min(high, fdr * below / max(tests, 1.0))
    while True:
        n = kinds.where(F.col("p_value") <= bound).agg(F.sum("k")).head()[0] or 0
        lower = fdr * n / max(tests, 1.0)
        if lower >= bound or n == 0:
            return bound if n else 0.0
        bound = lower
