"""Mixing sources to target shares of tokens by Sainte-Lague apportionment.

A mix of T tokens is cut into equal blocks. Blocks go to sources one after another to the highest quotient
share / (2 * blocks so far + 1); a source's blocks go to its shards by the same rule on the shards' tokens, so every
shard gets a whole number of blocks. Within a shard documents stand in a seeded order, and the first blocks of that
order are taken, all of them again for each full repetition.

Limits are tokens, not blocks: the last block of a source that reaches its cap is a part of one, so nothing that a
source may give is lost. Blocks are so small that the source from which least is wanted still gets FINEST of them,
however large the mix is. A source has as many shards as its tokens need, so a source with a third of all rows is many
tasks, and only one line per source, mix and shard reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from citeloom.llm.tokens import DEFAULT_TOKENIZER, token_count
from citeloom.runtime import cut

SHARD_TOKENS = 16_000_000  # tokens of a source per shard, about
MAX_SHARDS = 16_384  # bounds the lines the driver holds: beyond it shards grow, and nothing is left out
BLOCKS = 4096  # blocks of a mix at the least
FINEST = 256  # blocks of the source from which least is wanted, and of a shard, at the least


def sainte_lague(weights: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by the divisors 1, 3, 5 ...; ties go to the earlier weight; `limits` bounds the seats of each.

    Seats that any continuation would give (the result of a divisor so large that it cannot overshoot) are given at
    once, so the work grows with the number of weights and not with that of seats.
    """
    limits = [seats] * len(weights) if limits is None else [max(0, x) for x in limits]
    got, free = [0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    left = seats
    while free and left > 0:
        total, room = sum(weights[i] for i in free), left - len(free) / 2
        sure = {i: int(weights[i] * room / total + 0.5) if room > 0 else 0 for i in free}
        full = [i for i in free if sure[i] >= limits[i]]
        if not full:
            for i in free:
                got[i] = sure[i]
            left -= sum(sure.values())
            break
        for i in full:  # they reach their limit in any case; the others share what is left
            got[i] = limits[i]
            left -= limits[i]
        free = [i for i in free if sure[i] < limits[i]]
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in free]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(
    rows: Sequence[tuple[str, float, int]], held: Mapping[str, Mapping[int, int]], size: float,
    blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, refill: bool = False,
) -> list[tuple[str, int, float]]:
    """Tokens to take of each shard: (source, shard, tokens) of one mix of `size` tokens.

    `rows` are (source, target_share, max_repeats), `held` the tokens of each source by shard. Every source that has
    tokens and a share gets its share of the size within its cap, to about one block and one block per shard that it
    fills.
    """
    rows = sorted(rows)
    tokens = [sum(held.get(s, {}).values()) for s, _, _ in rows]
    most = [cap * t for (_, _, cap), t in zip(rows, tokens)]
    wanted = [min(share * size, m) for (_, share, _), m in zip(rows, most) if share > 0 and m > 0]
    if not wanted or size <= 0:
        return []
    block = max(1.0, min(size / blocks, min(wanted) / FINEST, shard_tokens / FINEST))
    limits = [int(-(-m // block)) for m in most]
    seats = round(size / block)
    given = sainte_lague([share for _, share, _ in rows], seats, limits if refill else None)
    out = []
    for (source, _, cap), n in zip(rows, given):
        own = sorted((k, t) for k, t in held.get(source, {}).items() if t > 0)
        room = [int(-(-cap * t // block)) for _, t in own]
        for (k, t), q in zip(own, _over_shards([t for _, t in own], room, n, max(1, int(shard_tokens / FINEST / block)))):
            if q:
                out.append((source, k, float(min(q * block, cap * t))))
    return out


def _over_shards(tokens: list[int], room: list[int], n: int, group: int) -> list[int]:
    """Blocks of each shard. They are given `group` at a time, so that a little is not spread over many shards until
    each gets less than a document."""
    if n >= sum(room):
        return room
    got = [q * group for q in sainte_lague(tokens, n // group, [r // group for r in room])]
    left = n - sum(got)
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i] / (2 * got[i] + 1), i)):
        more = min(left, room[i] - got[i])
        got[i] += more
        left -= more
    return got


def mix_sources(
    documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = DEFAULT_TOKENIZER,
    shard_tokens: int = SHARD_TOKENS, blocks: int = BLOCKS, refill: bool = False,
) -> DataFrame:
    """The chosen documents of every mix: mix_name, source, doc_id, tokens, repeats.

    `documents` has doc_id, text and source; `targets` has mix_name, source, target_share, max_repeats and size_ratio
    (tokens of the mix by tokens of all documents). A source gets its share of the mix's tokens, at most max_repeats
    times what it has; what it lacks is left out, or with `refill` given to the others. Documents of null or
    unwanted sources, with null or empty text are never chosen (their tokens count in the size of all documents).
    A source without documents gets none. Shares are cut at whole documents. Rows with the same doc_id are documents
    of their own. A null share, cap or ratio is 0. Empty tables give no rows.
    """
    sized = cut(documents.select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens")))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats", "size_ratio").collect()  # one row per mix and source
    names = sorted({r.source for r in wanted if r.source is not None})
    # One line per wanted source and one for all others.
    named = F.when(F.col("source").isin(names), F.col("source")) if names else F.lit(None).cast("string")
    per_source = {r.s: r.t or 0 for r in sized.groupBy(named.alias("s")).agg(F.sum("tokens").alias("t")).collect()}
    total = sum(per_source.values())
    per_source.pop(None, None)
    having = sized.where(F.col("source").isin(names) & (F.col("tokens") > 0)) if names else sized.limit(0)
    spark = documents.sparkSession
    shards = {s: min(MAX_SHARDS, max(1, -(-t // shard_tokens))) for s, t in per_source.items()}
    count = F.coalesce(F.create_map(*[x for s, n in shards.items() for x in (F.lit(s), F.lit(n))])[F.col("source")], F.lit(1)) if shards else F.lit(1)
    placed = having.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), count).cast("int"))
    held: dict[str, dict[int, int]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect():
        held.setdefault(r.source, {})[r.shard] = r.t
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    quotas = []
    for mix in sorted({r.mix_name for r in wanted}, key=str):
        rows = [r for r in wanted if r.mix_name == mix and r.source is not None]
        caps = {r.source: r.max_repeats or 0 for r in rows}
        size = max((r.size_ratio or 0.0 for r in rows), default=0.0) * total
        own = [(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in rows]
        quotas += [(mix, s, k, most, held[s][k], caps[s]) for s, k, most in shard_quotas(own, held, size, blocks, shard_tokens, refill)]
    share = spark.createDataFrame(quotas, "mix_name string, source string, shard int, most double, held bigint, cap int")
    # A document is taken in a further round if its middle lies among the shard's blocks.
    rounds = F.floor(F.col("most") / F.col("held"))
    rest = F.col("most") - rounds * F.col("held")
    again = F.when((rest > 0) & (F.col("start") + F.col("tokens") / 2 < rest), 1).otherwise(0)
    chosen = placed.join(F.broadcast(share) if len(quotas) < 10_000 else share, ["source", "shard"])
    return (
        chosen.withColumn("repeats", F.least(rounds + again, F.col("cap")).cast("int")).where("repeats > 0")
        .select("mix_name", "source", "doc_id", "tokens", "repeats")
    )


def shares_reached(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target_share, share, documents, copies, tokens and the largest number of repeats."""
    got = chosen.groupBy("mix_name", "source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats")
    )
    full = targets.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left").na.fill(0, ["documents", "copies", "mix_tokens", "most_repeats"])
    whole = F.sum("mix_tokens").over(Window.partitionBy("mix_name"))
    return full.withColumn("share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0))
