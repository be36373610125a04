"""Positions in a total order without moving all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096
#: Keys of one range where positions and neighbours are worked out within a group (a sender, an account).
GROUP_WIDTH = 1 << 20


def prefix_sums(df: DataFrame, key: str, amount: str, out: str, width: int = WIDTH, levels: int = 2) -> DataFrame:
    """df with the sum of `amount` over all rows with a smaller `key` (unique, integral)."""
    return running_sums(df, key, {out: amount}, width, levels)


def running_sums(df: DataFrame, key: str, amounts: dict[str, str], width: int = WIDTH, levels: int = 2) -> DataFrame:
    """df with the sum over all rows with a smaller `key` (unique, integral) of each amount: {new column: amount}.

    Keys fall into ranges of `width`, their totals into ranges of ranges, and so on: at the last level one
    total for each width ** levels keys meets in one window (60,000 for 10 ** 12 keys), the rest is
    summed within the ranges.
    """
    range_ = F.floor(F.col(key) / width).alias("__range")
    at = list(amounts.values())
    totals = df.groupBy(range_).agg(*[F.sum(c).alias(f"__total{k}") for k, c in enumerate(at)])
    if levels > 1:
        offsets = running_sums(totals, "__range", {f"__offset{k}": f"__total{k}" for k in range(len(at))}, width, levels - 1)
    else:
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumns({f"__offset{k}": F.coalesce(F.sum(f"__total{k}").over(before), F.lit(0)) for k in range(len(at))})
    offsets = offsets.select("__range", *[f"__offset{k}" for k in range(len(at))])
    held = "__held" if key == "__range" else key  # totals of ranges are keyed by their range
    rows = df.withColumnRenamed(key, held).withColumn("__range", F.floor(F.col(held) / width))
    inner = Window.partitionBy("__range").orderBy(held).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumns({f"__near{k}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in enumerate(at)})
    summed = near.join(offsets, "__range").withColumns({f"__sum{k}": (F.col(f"__offset{k}") + F.col(f"__near{k}")).cast("long") for k in range(len(at))})
    summed = summed.drop("__range", *[f"__{x}{k}" for x in ("offset", "near") for k in range(len(at))]).withColumnRenamed(held, key)
    return summed.withColumnsRenamed({f"__sum{k}": out for k, out in enumerate(amounts)})


def prefix_minima(df: DataFrame, key: str, amount: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the smallest `amount` of all rows up to its `key` (unique, integral), its own included.

    Only minima of ranges, and of ranges of ranges, meet.
    """
    slot = lambda k: F.floor(F.col(key) / width**k)
    held, parts = df.withColumns({"__1": slot(1), "__2": slot(2)}), ["__2", "__1"]
    lows = held.groupBy(*parts).agg(F.min(amount).alias("__low"))
    tops = lows.groupBy("__2").agg(F.min("__low").alias("__top"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__2", F.min("__top").over(earlier(Window.orderBy("__2"))).alias("__before2"))
    lows = lows.select(*parts, F.min("__low").over(earlier(Window.partitionBy("__2").orderBy("__1"))).alias("__before1"))
    own = F.min(amount).over(Window.partitionBy(*parts).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    rows = held.withColumn("__own", own).join(lows, parts).join(tops, "__2")
    return rows.withColumn(out, F.least("__own", "__before1", "__before2")).drop("__1", "__2", "__own", "__before1", "__before2")


def take_until(df: DataFrame, keys: list[str], needs: dict[str, int]) -> DataFrame:
    """The first rows by ascending keys (integral, together unique) until the sum of every amount named in
    `needs` reaches what is needed; all rows if they don't suffice, none if nothing is needed.

    Key by key, the value where that happens is found from totals of ranges of values, each a WIDTH-th of the
    one before: at most WIDTH totals are looked at a time, and no task gets all rows.
    """
    if all(n <= 0 for n in needs.values()):
        return df.limit(0)
    taken = df.limit(0)
    for depth, key in enumerate(keys):
        cut = _reached(df, key, needs)
        if cut is None:
            return taken.unionByName(df)
        value, before = cut
        last = depth == len(keys) - 1
        taken = taken.unionByName(df.where(F.col(key) <= value if last else F.col(key) < value))
        df, needs = df.where(F.col(key) == value), {c: n - before[c] for c, n in needs.items()}
    return taken


def _reached(df: DataFrame, key: str, needs: dict[str, int], width: int = WIDTH) -> tuple[int, dict[str, int]] | None:
    """The value of key at which all sums reach what is needed, and the sums before it; None if they don't."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return None
    lo, hi, step, before = ends["lo"], ends["hi"], 1, dict.fromkeys(needs, 0)
    while (hi - lo) // step >= width:
        step *= width
    while True:
        slot = F.call_function("div", F.col(key) - F.lit(lo), F.lit(step)).alias("__slot")
        totals = df.where(F.col(key).between(lo, hi)).groupBy(slot).agg(*[F.sum(c).alias(c) for c in needs]).collect()  # at most `width`
        for row in sorted(totals, key=lambda r: r["__slot"]):
            after = {c: before[c] + (row[c] or 0) for c in needs}
            if all(after[c] >= n for c, n in needs.items()):
                lo, hi = lo + row["__slot"] * step, lo + (row["__slot"] + 1) * step - 1
                break
            before = after
        else:
            return None
        if step == 1:
            return lo, before
        step //= width


def position_within(df: DataFrame, groups: list[str], key: str, out: str, width: int = GROUP_WIDTH, total: str | None = None) -> DataFrame:
    """df with the number of rows of its group that have a smaller key (unique, integral), and, if asked for, of all its rows.

    A group is split at ranges of keys, so that one with very many rows is not one task; only counts of its
    ranges meet.
    """
    range_ = F.floor(F.col(key) / width)
    counts = df.groupBy(*groups, range_.alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__n").over(Window.partitionBy(*groups)))
    inner = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(key)) - 1
    placed = df.withColumn("__range", range_).withColumn("__at", inner).join(offsets.drop("__n"), [*groups, "__range"])
    return placed.withColumn(out, (F.col("__offset") + F.col("__at")).cast("long")).drop("__range", "__at", "__offset")


def previous_within(df: DataFrame, groups: list[str], key: str, value: str, out: str, width: int = GROUP_WIDTH) -> DataFrame:
    """df with `value` of the row of its group that comes before it by key (unique, integral); null for the first.

    As above: a group is split at ranges of keys, and only the last value of each range is carried on.
    """
    range_ = F.floor(F.col(key) / width)
    lasts = df.groupBy(*groups, range_.alias("__range")).agg(F.max_by(F.struct(value), key).alias("__last"))
    carried = lasts.select(*groups, "__range", F.lag("__last").over(Window.partitionBy(*groups).orderBy("__range")).alias("__carried"))
    inner = F.lag(F.struct(value)).over(Window.partitionBy(*groups, "__range").orderBy(key))
    joined = df.withColumn("__range", range_).withColumn("__near", inner).join(carried, [*groups, "__range"])
    return joined.withColumn(out, F.coalesce("__near", "__carried")[value]).drop("__range", "__near", "__carried")


def next_within(df: DataFrame, groups: list[str], key: str, value: str, out: str, width: int = GROUP_WIDTH, slot: Column | None = None) -> DataFrame:
    """df with the first `value` that is not null among the rows of its group with a greater key (unique, integral); null if none.

    As above: a group is split at ranges of keys, and only the first value of each range is carried back. Keys
    of other types are split by slot, which must not fall as keys rise.
    """
    range_ = F.floor(F.col(key) / width) if slot is None else slot
    firsts = df.where(F.col(value).isNotNull()).groupBy(*groups, range_.alias("__range")).agg(F.min_by(value, key).alias("__first"))
    ranges = df.groupBy(*groups, range_.alias("__range")).agg(F.count(F.lit(1)).alias("__n")).drop("__n").join(firsts, [*groups, "__range"], "left")
    # Orders fall, as frames up to the end of a group are worked out anew for every row.
    later = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*groups, "__range", F.last("__first", ignorenulls=True).over(later(Window.partitionBy(*groups).orderBy(F.desc("__range")))).alias("__carried"))
    inner = F.last(value, ignorenulls=True).over(later(Window.partitionBy(*groups, "__range").orderBy(F.desc(key))))
    joined = df.withColumn("__range", range_).withColumn("__near", inner).join(carried, [*groups, "__range"])
    return joined.withColumn(out, F.coalesce("__near", "__carried")).drop("__range", "__near", "__carried")


def positions(df: DataFrame, key: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with the number of rows that have a smaller key (unique, integral): 0, 1, 2, ..."""
    return prefix_sums(df.withColumn("__one", F.lit(1)), key, "__one", out, width).drop("__one")


def day_hours(ts: str) -> Column:
    """Hours since 1970 of a timestamp without zone, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("long")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return (day_hours(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")
