"""Exact order statistics (median, percentiles) without holding a whole group in one task.

Spark's ``median``/``percentile`` keep a value->count map per group and merge
it in a single task, so one hot group (a third of all rows) would have to fit
in one executor. Here every long is written as a few digits of a mixed radix
that depend on the value alone and keep its order:

* the first digit says between which two of 1024 steps per power of two the
  value lies (sign, bit length and the next ten bits), so a few thousand
  digits cover whatever range the data have, negative values included;
* the others split what is left of that step, 16 to 18 bits at a time.

Level 1 counts rows per (group, first digit): one partial aggregate with no
join, and the number of rows of a group is the sum of its histogram, so all
wanted ranks are read off it. Each later level looks only at rows in a digit
that holds a wanted rank (an equi-join with a table of one row per such digit).
A histogram has at most 2^18 rows per group whatever the data; nothing is
collected to the driver and no job runs before the caller's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_BITS = 10                       # steps per power of two in the first digit
DIGIT_BITS = (16, 18, 18)            # the later digits; with the first they cover any long
SHORT_BITS = 45                      # magnitudes below 2^45 need two of them


def _digits(v: Column, levels: int) -> list[Column]:
    """The digits of a long, most significant first."""
    size = F.when(v < 0, -(v + 1)).otherwise(v)
    rest_bits = F.greatest(F.length(F.bin(size)) - (STEP_BITS + 1), F.lit(0))
    step = rest_bits * (1 << STEP_BITS) + F.call_function("shiftright", size, rest_bits)
    rest = size - F.call_function("shiftleft", F.call_function("shiftright", size, rest_bits), rest_bits)
    # mirrored below zero, so that a larger digit is a larger value there too
    full = F.call_function("shiftleft", F.lit(1).cast("long"), rest_bits) - 1
    rest = F.when(v < 0, full - rest).otherwise(rest)
    out, used = [F.when(v < 0, -step - 1).otherwise(step)], F.lit(0)
    for bits in DIGIT_BITS[:levels - 1]:
        left = F.greatest(rest_bits - used - bits, F.lit(0))
        out.append(F.call_function("shiftright", rest, left))
        rest = rest - F.call_function("shiftleft", F.call_function("shiftright", rest, left), left)
        used = used + bits
    return out


def order_statistics(values: DataFrame, keys: list[str], value_col: str, ranks: Column, below: int | None = None) -> DataFrame:
    """keys, ``kid``, ``value``: the wanted order statistics of the non-null longs of each group.

    ``ranks`` is an array<struct<kid, k>> computed from ``_n``, the number of
    values of the group: which statistic, and its 1-based rank. ``below``: a bound that
    the caller knows for the values' magnitude saves a pass when under 2^45.
    """
    levels = 3 if below is not None and below <= 1 << SHORT_BITS else 4
    names = [f"_d{j}" for j in range(levels)]
    groups = [f"_g{j}" for j in range(len(keys))]
    v = F.col(value_col)
    rows = values.where(v.isNotNull()).select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], v.alias("_v"),
                                              *[d.alias(n) for d, n in zip(_digits(v, levels), names)])
    spots = None         # one row per digit prefix that holds wanted ranks: which, and their ranks in it
    for j, name in enumerate(names):
        own = groups + names[:j]
        hit, carried = rows, []
        if spots is not None:
            same = [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in groups] + [F.col(c) == F.col(f"_t{c}") for c in names[:j]]
            hit = rows.join(spots.withColumnsRenamed({c: f"_t{c}" for c in own}), reduce(lambda a, b: a & b, same))
            carried = [F.any_value("_wanted").alias("_wanted")]
        last = [F.min("_v").alias("_v")] if j == levels - 1 else []     # one value per last digit
        hist = hit.groupBy(*own, name).agg(F.count(F.lit(1)).alias("_c"), *carried, *last)
        hist = hist.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*own).orderBy(name)))
        if spots is None:
            hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*own))).withColumn("_wanted", ranks)
        below_it = F.col("_upto") - F.col("_c")
        here = F.filter("_wanted", lambda w: (below_it < w["k"]) & (w["k"] <= F.col("_upto")))
        inside = F.transform(here, lambda w: F.struct(w["kid"].alias("kid"), (w["k"] - below_it).alias("k")))
        spots = hist.select(*own, name, inside.alias("_wanted"), *(["_v"] if last else [])).where(F.size("_wanted") > 0)
    return spots.select(*[F.col(g).alias(k) for k, g in zip(keys, groups)], F.explode("_wanted").alias("_w"), "_v").select(
        *keys, F.col("_w.kid").alias("kid"), F.col("_v").alias("value"))


def exact_median(values: DataFrame, keys: list[str], value_col: str, below: int | None = None) -> DataFrame:
    """Median (mean of the two middle values for even counts) per group.

    Returns keys, median (double, same unit as ``value_col``). Groups with
    no non-null value are absent.
    """
    if not keys:
        # one global group; the key is derived from the data (not a literal the
        # optimizer would fold away), so every level stays a hash equi-join
        return exact_median(values.withColumn("_all", F.col(value_col).isNotNull()), ["_all"], value_col, below).drop("_all")
    n = F.col("_n")
    ranks = F.array(F.struct(F.lit(0).alias("kid"), (F.call_function("div", n - 1, F.lit(2)) + 1).alias("k")),
                    F.struct(F.lit(1).alias("kid"), (F.call_function("div", n, F.lit(2)) + 1).alias("k")))
    picked = order_statistics(values, keys, value_col, ranks, below)
    # mean of the two middle values in exact decimal, rounded to double once
    return picked.groupBy(*keys).agg(F.avg(F.col("value").cast("decimal(38,0)")).cast("double").alias("median"))


def exact_percentiles(values: DataFrame, keys: list[str], value_col: str, ps: list[float],
                      below: int | None = None) -> DataFrame:
    """Nearest-rank percentiles (the ``ceil(p * n)``-th smallest) per group.

    Returns keys plus one column ``p<100p>`` per requested percentile
    (e.g. ``p95``), in the unit of ``value_col`` (long).
    """
    ranks = F.array(*[F.struct(F.lit(i).alias("kid"), F.greatest(F.ceil(F.col("_n") * F.lit(float(p))), F.lit(1))
                               .cast("long").alias("k")) for i, p in enumerate(ps)])
    picked = order_statistics(values, keys, value_col, ranks, below)
    aggs = [F.max(F.when(F.col("kid") == i, F.col("value"))).alias(f"p{round(p * 100):d}") for i, p in enumerate(ps)]
    return picked.groupBy(*keys).agg(*aggs)
