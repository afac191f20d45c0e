"""Dense yearly series and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def dense_series(counts: DataFrame, key: str, start: int, end: int, measure: str = "ind", year: str = "fy") -> DataFrame:
    """(key, year, count, share): every year of the span for every key; share is of the year's total, 0 where that is 0."""
    inside = counts.where(F.col(year).between(start, end) & F.col(key).isNotNull())
    spine = inside.select(key).distinct().select(key, F.explode(F.sequence(F.lit(start), F.lit(end))).alias(year))
    totals = inside.groupBy(year).agg(F.sum(measure).alias("total"))
    rows = spine.join(inside.groupBy(key, year).agg(F.sum(measure).alias("count")), [key, year], "left").join(totals, year, "left")
    count = F.coalesce("count", F.lit(0))
    return rows.select(key, F.col(year).alias("year"), count.alias("count"), F.coalesce(F.try_divide(count, F.col("total")), F.lit(0.0)).alias("share"))


def trend_stats(series: DataFrame, key: str) -> DataFrame:
    """Per key: first and last year with a count, the year and height of the largest count and share, totals.

    Ties of the largest go to the latest year; a key without any count gives no row.
    """
    seen = F.col("count") > 0
    rows = series.groupBy(key).agg(
        F.min(F.when(seen, F.col("year"))).alias("first"), F.max(F.when(seen, F.col("year"))).alias("last"),
        F.max_by("year", F.struct("count", "year")).alias("maxcounty"), F.max("count").alias("maxcount"),
        F.max_by("year", F.struct("share", "year")).alias("maxpropy"), F.max("share").alias("maxprop"),
        F.sum("count").alias("total"), F.sum("share").alias("totalprop"),
    )
    return rows.where("first is not null")


def range_sums(series: DataFrame, key: str, width: int) -> DataFrame:
    """Sum and mean of the last `width` years up to each year that has so many before it."""
    window = Window.partitionBy(key).orderBy("year").rowsBetween(-(width - 1), 0)
    place = F.row_number().over(Window.partitionBy(key).orderBy("year"))
    rows = series.withColumn("range_sum", F.sum("count").over(window)).withColumn("place", place).where(F.col("place") >= width)
    return rows.select(key, "year", "range_sum", (F.col("range_sum") / width).alias("range_mean"))


def between(series: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Sum and mean over an inclusive span; a reversed span is an error."""
    if low > high:
        raise ValueError(f"span {low}..{high} is reversed")
    return series.where(F.col("year").between(low, high)).groupBy(key).agg(F.sum("count").alias("span_sum"), (F.sum("count") / (high - low + 1)).alias("span_mean"))


def rolling_windows(counts: DataFrame, key: str, start: int, end: int, width: int = 10, measure: str = "ind", year: str = "fy") -> DataFrame:
    """(window, key, n): counts in every window of `width` years, named by its first year; only keys met at all in it."""
    rows = counts.where(F.col(year).between(start, end) & F.col(key).isNotNull())
    starts = F.sequence(F.greatest(F.lit(start), F.col(year) - (width - 1)), F.least(F.col(year), F.lit(end - width + 1)))
    spread = rows.where(F.greatest(F.lit(start), F.col(year) - (width - 1)) <= F.least(F.col(year), F.lit(end - width + 1)))
    return spread.select(key, measure, F.explode(starts).alias("window")).groupBy("window", key).agg(F.sum(measure).alias("n")).where("n > 0")


def top_share(windows: DataFrame, key: str, percentile: float) -> DataFrame:
    """Members of each window whose count reaches the (1 - percentile) quantile; ties at the edge are kept."""
    edge = windows.groupBy("window").agg(F.percentile("n", F.lit(1.0 - percentile)).alias("edge"))
    return windows.join(edge, "window").where("n >= edge").select("window", key, "n")


def top_count(windows: DataFrame, key: str, n: int, max_share: float | None = None) -> DataFrame:
    """The `n` largest of each window, ties by key; windows of which `n` is more than `max_share` are left out.

    Ranks are taken by Spark's window group limit, which keeps n rows a task before the shuffle.
    """
    order = Window.partitionBy("window").orderBy(F.desc("n"), key)
    rows = windows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if max_share is not None:
        sizes = windows.groupBy("window").agg(F.count("*").alias("size")).where(F.lit(n) <= F.col("size") * max_share)
        rows = rows.join(sizes.select("window"), "window", "left_semi")
    return rows.select("window", key, "n", "rank")


def first_added(top: DataFrame, key: str) -> DataFrame:
    """First window in which each key is at the top."""
    return top.groupBy(key).agg(F.min("window").alias("first_added"))


def top_decade_stratified(
    counts: DataFrame, key: str, start: int, end: int, percentile: float | None = None, top_n: int | None = None,
    max_share: float | None = None, width: int = 10, least: int = 5, measure: str = "ind", year: str = "fy",
) -> DataFrame:
    """The keys that are at the top of any window of `width` years, with their trend and the window that first had them.

    Keys need `least` counts in all. The top is the `percentile` share of each window, ties kept, or its `top_n`
    largest, ties by key; without either, the top hundredth. Columns: key, those of `trend_stats`, first_added.
    """
    if percentile is not None and top_n is not None:
        raise ValueError("either percentile or top_n")
    often = counts.groupBy(key).agg(F.sum(measure).alias("_all")).where(F.col("_all") >= least).select(key)
    windows = rolling_windows(counts.join(often, key, "left_semi"), key, start, end, width, measure, year)
    top = top_count(windows, key, top_n, max_share) if top_n is not None else top_share(windows, key, 0.01 if percentile is None else percentile)
    added = first_added(top, key)
    # Shares are of all counts of a year, so the series is made before the others are left out.
    return trend_stats(dense_series(counts, key, start, end, measure, year), key).join(added, key)


def births_deaths(series: DataFrame, key: str, birth_cutoff: float = 0.5, death_cutoff: float = 0.1, forward: int = 10, backward: int = 5) -> DataFrame:
    """(key, event, year): births and deaths of each key's popularity.

    A key is born in its first year. It dies in the first year from `backward` years after its birth on in which the
    mean of the next `forward` years is at most `death_cutoff` of the mean since birth; dead for `forward` years, it is
    born again in a year with a count when the mean to come is above `birth_cutoff` of its last life's mean. The fold
    runs inside the JVM over one array per key.
    """
    arrays = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("year", "count"))).alias("s"))
    return arrays.selectExpr(f"`{key}`", "s", "transform(s, x -> cast(x.count as double)) as v", "s[0].year as y0", "size(s) as n").selectExpr(
        f"`{key}`",
        f"""explode(aggregate(
            sequence(0, n - 1),
            named_struct('events', cast(array() as array<struct<event:string,year:int>>), 'at', -1, 'alive', false, 'life', cast(null as double)),
            (acc, i) -> CASE
              WHEN acc.at < 0 AND v[i] > 0 THEN
                named_struct('events', array(named_struct('event', 'birth', 'year', cast(y0 + i as int))), 'at', i, 'alive', true, 'life', cast(null as double))
              WHEN acc.at < 0 OR i > n - 1 - {forward} THEN acc
              WHEN acc.alive AND i >= acc.at + {backward}
                AND (aggregate(slice(v, i + 1, {forward}), 0D, (a, x) -> a + x) / {forward})
                    <= {death_cutoff} * (aggregate(slice(v, acc.at + 1, i - acc.at), 0D, (a, x) -> a + x) / (i - acc.at)) THEN
                named_struct('events', concat(acc.events, array(named_struct('event', 'death', 'year', cast(y0 + i as int)))), 'at', i, 'alive', false,
                             'life', aggregate(slice(v, acc.at + 1, i - acc.at), 0D, (a, x) -> a + x) / (i - acc.at))
              WHEN NOT acc.alive AND i >= acc.at + {forward} AND v[i] > 0
                AND (aggregate(slice(v, i + 1, {forward}), 0D, (a, x) -> a + x) / {forward}) > {birth_cutoff} * acc.life THEN
                named_struct('events', concat(acc.events, array(named_struct('event', 'birth', 'year', cast(y0 + i as int)))), 'at', i, 'alive', true, 'life', acc.life)
              ELSE acc END,
            acc -> acc.events)) as e""",
    ).select(key, "e.event", "e.year")


def yearly_table(series: DataFrame, key: str, tail: int = 15) -> DataFrame:
    """Per key: largest and last count, mean of the last `tail` years, and per year the count by the largest."""
    last = Window.partitionBy(key).orderBy(F.desc("year"))
    ranked = series.withColumn("back", F.row_number().over(last))
    per = ranked.groupBy(key).agg(F.max("count").alias("max_count"), F.max_by("count", "year").alias("last_count"), F.avg(F.when(F.col("back") <= tail, F.col("count"))).alias("tail_mean"))
    return series.join(per, key).select(key, "year", "max_count", "last_count", "tail_mean", F.try_divide("count", "max_count").alias("of_max"))


def trend_rejects(counts: DataFrame, key: str, start: int, end: int, least_docs: int = 5, least_total: int = 5) -> DataFrame:
    """How many keys are left out of the trends and why: (reason, n)."""
    per = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("doc").alias("docs"), F.sum(F.when(F.col("fy").between(start, end), F.col("ind")).otherwise(0)).alias("total"))
    reason = F.when(F.col("docs") < least_docs, "few documents").when(F.col("total") == 0, "no count in the span").when(F.col("total") < least_total, "small total").otherwise("kept")
    return per.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
