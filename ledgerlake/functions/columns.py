"""Column helpers: text cleaning, value maps, guarded arithmetic and windows with a least number of rows."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlake.constants import UNITS_PER_EUR, UNMAPPED


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean_text(c: Column | str) -> Column:
    """Without spaces at the ends; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def map_values(c: Column, mapping: dict[str, str], otherwise: Column | None = None, null_to: str | None = None) -> Column:
    """The mapped value; ``otherwise`` (or the value itself) for unknown ones; ``null_to`` for null."""
    literal = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    known = F.coalesce(F.try_element_at(literal, c), c if otherwise is None else otherwise)
    return F.when(c.isNull(), F.lit(null_to)).otherwise(known)


def closed_values(c: Column, mapping: dict[str, str]) -> Column:
    return map_values(c, mapping, F.lit(UNMAPPED))


def units_per_eur(currency: Column) -> Column:
    literal = F.create_map(*(F.lit(x) for pair in UNITS_PER_EUR.items() for x in pair))
    return F.coalesce(F.try_element_at(literal, F.upper(F.trim(currency))), F.lit(1.0))


def safe_div(a: Column, b: Column) -> Column:
    """Of doubles; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    """Null stays null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def rolling(agg, c: str, over: WindowSpec, rows: int, least: int | None = None) -> Column:
    """agg of the last ``rows`` rows, this one included; null with fewer than ``least`` values."""
    frame = over.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) >= (rows if least is None else least), agg(F.col(c)).over(frame))


def previous(agg, c: Column, over: WindowSpec, rows: int) -> Column:
    """agg of the ``rows`` rows before this one; null unless all have values."""
    frame = over.rowsBetween(-rows, -1)
    return F.when(F.count(c).over(frame) == rows, agg(c).over(frame))


def median_over(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def month_of(c: Column | str) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def half_up(c: Column) -> Column:
    """Whole numbers, halves upwards."""
    return F.floor(c + F.lit(0.5))


def whole_text(c: Column) -> Column:
    """A number as text without decimals, thousands set off by commas, halves away from zero; format_number alone takes them
    to the even neighbour."""
    return F.format_number(F.round(c, 0), 0)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first four bytes of their SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Ranges into which a pass over the values splits an interval, and rows of an interval that are sorted in one place.
RANGES, FEW = 1 << 14, 1 << 14


def exact_quantiles(df: DataFrame, c: str, shares: tuple[float, ...]) -> list[float | None]:
    """Quantiles of c over all rows, exact, with linear interpolation; null and NaN don't count; None without values.

    Each pass counts the values in RANGES parts of the intervals that hold the wanted ranks, so an interval shrinks until
    it has one value or FEW rows. Counts combine before they meet: no task or driver ever holds the values of all rows.
    Parts are equal on a logarithmic scale of both signs, since money has a long tail.
    """
    x = F.col(c).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    scale = F.signum("x") * F.log1p(F.abs("x"))
    n, lo, hi, lo_at, hi_at = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min(scale), F.max(scale)).first()
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * p for p in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found: dict[int, float] = {}
    open_ = {(0, n, lo, hi, lo_at, hi_at): ranks}  # interval: values before it, in it, their least and largest, and scaled
    while open_:
        found |= {r: edges[2] for edges, wanted in open_.items() for r in wanted if edges[2] == edges[3]}
        open_ = {edges: wanted for edges, wanted in open_.items() if edges[2] < edges[3]}
        if not open_:
            break
        # One pass for all intervals, which don't meet: values of few are counted one by one, others by part.
        which, key = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, (_, size, lo, hi, lo_at, hi_at) in enumerate(open_):
            inside = (F.col("x") >= lo) & (F.col("x") <= hi)
            part = F.least(F.floor((scale - lo_at) / F.lit((hi_at - lo_at) / RANGES or 1.0)).cast("double"), F.lit(RANGES - 1.0))
            which, key = F.when(inside, k).otherwise(which), F.when(inside, F.col("x") if size <= FEW or lo_at == hi_at else part).otherwise(key)
        met = rows.select("x", which.alias("which"), key.alias("key")).where("which IS NOT NULL").groupBy("which", "key").agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min(scale), F.max(scale)).collect()
        following: dict[tuple, list[int]] = {}
        for k, ((before, *_), wanted) in enumerate(open_.items()):
            at = before
            for _, _, count, *edges in sorted(m for m in met if m[0] == k):
                if mine := [r for r in wanted if at <= r < at + count]:
                    following[(at, count, *edges)] = mine
                at += count
        open_ = following
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        out.append(found[a] if a == b or found[a] == found[b] else (b - p) * found[a] + (p - a) * found[b])
    return out


#: Bins of a unit of the logarithmic scale into which quantiles_by() deals a group's values.
BINS = 1 << 12


def quantiles_by(df: DataFrame, keys: list[str], c: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys and, for each name of shares, the quantile of c in the group, exact, with linear interpolation; null and NaN
    don't count, a group without values has no row. weight: how often a row counts, whole numbers, 1 by default.

    Equal values are counted before they meet, and a group's values are dealt to bins of a scale that all groups share; the
    places of a bin's values follow from the counts of the bins before it. So of a group, however large, only the counts of
    its bins meet in one task, and the values of one bin.
    """
    x = F.col(c).cast("double")
    inner = [f"__k{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)), x.alias("__x"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("__w"))
    counts = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.col("__w") > 0)).groupBy(*inner, (F.col("__x") + F.lit(0.0)).alias("__x")).agg(F.sum("__w").alias("__n"))
    counts = counts.withColumn("__bin", F.floor(F.signum("__x") * F.log1p(F.abs("__x")) * F.lit(float(BINS))))
    upto = Window.partitionBy(*inner).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*inner, "__bin").agg(F.sum("__n").alias("__size")).withColumns({"__before": F.coalesce(F.sum("__size").over(upto), F.lit(0)), "__total": F.sum("__size").over(Window.partitionBy(*inner))})
    ranks = {f"__r{k}_{end}": f(F.lit(float(p)) * (F.col("__total") - 1)) for k, p in enumerate(shares.values()) for end, f in (("a", F.floor), ("b", F.ceil))}
    bins = bins.withColumns(ranks)
    # Only bins that hold a wanted place matter from here on.
    holds = reduce(or_, ((F.col(r) >= F.col("__before")) & (F.col(r) < F.col("__before") + F.col("__size")) for r in ranks))
    wanted = bins.where(holds).select(*(F.col(i).alias(f"{i}_") for i in inner), F.col("__bin").alias("__bin_"), "__before", "__total", *ranks)
    on = reduce(and_, (F.col(i).eqNullSafe(F.col(f"{i}_")) for i in (*inner, "__bin")))
    within = Window.partitionBy(*inner, "__bin").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    met = counts.join(wanted, on).withColumn("__upto", F.col("__before") + F.sum("__n").over(within))
    at = lambda r: F.max(F.when((F.col(r) < F.col("__upto")) & (F.col(r) >= F.col("__upto") - F.col("__n")), F.col("__x"))).alias(r)
    found = met.groupBy(*inner).agg(F.max("__total").alias("__total"), *map(at, ranks))
    out = []
    for k, (name, p) in enumerate(shares.items()):
        a, b, place = F.col(f"__r{k}_a"), F.col(f"__r{k}_b"), F.lit(float(p)) * (F.col("__total") - 1)
        out.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b).alias(name))
    return found.select(*(F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)), *out)


def winsorised(df: DataFrame, c: str, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """df with c clipped to its own quantiles over all rows, which are found first; df is read several times for that."""
    low, high = exact_quantiles(df, c, (lo, hi))
    return df if low is None else df.withColumn(c, clip(F.col(c), low, high))
