"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. The rates at which its documents
are taken are the closest to 1 (in relative entropy, no rate above the cap)
whose words sum to the target: rate = min(cap, exp(lambda * size / mean size)),
an exponential tilt with one dual variable per source. The convex dual is solved
by safeguarded Newton steps, all sources at once, on the distributed table of
(source, size) counts, which holds all that the dual depends on.

Rates become copies by one threshold per source: a document is taken
floor(rate + u + tau) times, u being a hash of the document; rows equal in id and
text are numbered and draw one after the other, evenly spread. tau is found by
narrowing a histogram of the values at which a document gains a copy, and then
single documents are added or left out to close what is left of the gap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

SEED = 20
BINS = 1024
LOW, SPAN = -3.0, 6.0            # every threshold lies inside
GOLDEN = (5 ** 0.5 - 1) / 2
EXACT = "decimal(38,6)"          # sums that don't depend on the order of addition, so that reruns agree


@dataclass
class Mix:
    """``rows(id, source, size, h, row, nth)``, ``numbers(row, nth)`` of repeated rows, ``params`` per source,
    ``flips(sid, h, nth, delta)``: at most a few per source."""
    rows: DataFrame
    numbers: DataFrame
    params: DataFrame
    flips: DataFrame
    cap: float


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """``sizes(source, source_size, ...)`` -> the same with ``sid`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``budget`` times all words; a target stops at ``cap`` times its source's
    size and the excess is reshared by weight. That ends at the water level
    where sum(min(cap * size, level * weight)) is the whole budget; the level
    is read off running sums over the sources by size per weight. The windows
    see one row per source."""
    rank = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(rank).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * float(cap)})
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * float(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / F.sum("weight").over(rest)
    levels = ranked.withColumns({"level": level, "place": F.row_number().over(order)})
    fits = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("place", "level"))).over(every)
    return levels.withColumn("fits", fits).select(
        *sizes.columns, "sid",
        F.when(F.col("fits").isNull(), F.col("most")).otherwise(
            F.least("most", F.col("fits.level") * F.col("weight"))).alias("target"))


def _solve(counts: DataFrame, targets: DataFrame, cap: float, rounds: int) -> DataFrame:
    """Newton on the dual: ``targets`` with ``lam``; null where the rate is the cap throughout."""
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = written(targets.select(
        "*", F.lit(0.0).alias("lam"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"),
        (full | (F.col("source_size") == 0)).alias("done"), full.alias("full")))
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(cap), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    words = F.col("n") * F.col("size") * rate
    slope = F.when(F.col("lam") * x < F.log(F.lit(cap)), words * x).otherwise(0.0)
    for _ in range(rounds):
        sums = counts.join(state.where("NOT done").select("sid", "lam", "mean"), "sid").groupBy("sid").agg(
            F.sum(words.cast(EXACT)).cast("double").alias("words"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        gap = F.col("words") - F.col("target")
        near = F.abs(gap) <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)
        stepped = state.join(sums, "sid", "left").withColumns({
            "lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")),
            "newton": F.col("lam") - F.try_divide(gap, F.col("slope"))})
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        state = written(stepped.select(
            *targets.columns,
            F.when(F.col("done") | near, F.col("lam")).when(inside, F.col("newton"))
            .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
            "lo", "hi", (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"), "full"))
        if state.where("NOT done").isEmpty():
            break
    return state.select(*targets.columns, F.when(~F.col("full"), F.col("lam")).alias("lam"))


def _rate(cap: float) -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def _u() -> Column:
    """A row's draw in [0, 1): by its hash, and the golden section further for each equal row before it."""
    u = F.pmod("h", F.lit(1 << 40)) / float(1 << 40) + F.col("nth") * GOLDEN
    return u - F.floor(u)


def repeated_numbers(rows: DataFrame) -> DataFrame:
    """``rows(h, row)`` -> ``(row, nth)`` of the rows whose ``h`` is not theirs alone, numbered from 0. A large
    group of equal rows is numbered by partitions of the table, and each partition starts where those before end."""
    same = written(rows.groupBy("h").count().where("count > 1").select("h"))
    own = rows.join(same, "h").select("h", "row", F.shiftrightunsigned("row", 33).alias("part"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("h", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("h", "part").orderBy("row")) - 1
    return written(own.withColumn("place", place).join(starts, ["h", "part"]).select(
        "row", (F.col("start") + F.col("place")).alias("nth")))


def with_numbers(rows: DataFrame, numbers: DataFrame, row_col: str = "row") -> DataFrame:
    """``rows`` with ``nth``, 0 for a row that no other equals. Only repeated rows have a number; Spark broadcasts
    them while they are few."""
    other = numbers.withColumnRenamed("row", "_numbered")
    return rows.join(other, F.col(row_col) == F.col("_numbered"), "left").drop("_numbered").withColumn(
        "nth", F.coalesce("nth", F.lit(0).cast("long")))


def _copies(cap: float) -> Column:
    free = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.floor(_rate(cap) + _u() + F.col("tau"))))
    return F.when(F.col("lam").isNull(), F.lit(int(cap))).otherwise(free.cast("int"))


def _thresholds(rows: DataFrame, solved: DataFrame, cap: float, passes: int) -> DataFrame:
    """``solved`` with ``tau``: the threshold at which the copies' words are nearest the target."""
    gains = F.explode(F.array(*[F.lit(float(k)) for k in range(1, int(cap) + 1)])).alias("k")
    state = solved.withColumns({"lo": F.lit(LOW), "span": F.lit(SPAN), "below": F.lit(0.0)})
    params = state
    for _ in range(passes):
        params = written(state)
        items = (rows.where("size > 0").join(params.where("lam IS NOT NULL"), "sid")
                 .select("*", gains)
                 .withColumn("at", F.col("k") - _rate(cap) - _u())
                 .where("at > lo AND at <= lo + span")
                 .withColumn("bin", F.least(F.ceil((F.col("at") - F.col("lo")) / F.col("span") * BINS), F.lit(BINS))))
        bins = items.groupBy("sid", "bin").agg(F.sum("size").alias("w"))
        run = F.sum("w").over(Window.partitionBy("sid").orderBy("bin"))
        fit = (bins.withColumn("run", run).join(params.select("sid", "target", F.col("below").alias("was")), "sid")
               .where(F.col("was") + F.col("run") <= F.col("target"))
               .groupBy("sid").agg(F.max("bin").alias("bin"), F.max("run").alias("run")))
        # the bin after the last that fits holds the threshold
        state = params.join(fit, "sid", "left").select(
            *solved.columns,
            (F.col("lo") + F.coalesce("bin", F.lit(0)) / BINS * F.col("span")).alias("lo"),
            (F.col("span") / BINS).alias("span"),
            (F.col("below") + F.coalesce("run", F.lit(0))).alias("below"))
    return written(state.select(*solved.columns, F.col("lo").alias("tau")))


def _close_gaps(rows: DataFrame, params: DataFrame, cap: float, rounds: int) -> DataFrame:
    """At most ``rounds`` documents per source that are taken once more or once
    less: each time the largest that is not larger than what is left of the gap."""
    spark = rows.sparkSession
    flips = spark.createDataFrame([], "sid long, h long, nth long, delta int")
    for _ in range(rounds):
        taken = (rows.where("size > 0").join(params.where("lam IS NOT NULL"), "sid")
                 .join(flips, ["sid", "h", "nth"], "left")
                 .withColumn("copies", _copies(cap) + F.coalesce("delta", F.lit(0))))
        # a written table of one row per source: known to be small, it doesn't make the documents move
        gaps = written(taken.groupBy("sid", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).select(
            "sid", (F.col("target") - F.col("words")).alias("gap")))
        best = F.max(F.struct("size", "h", "nth"))
        more = (taken.join(gaps, "sid").where("delta IS NULL AND size <= abs(gap)")
                .where(((F.col("gap") > 0) & (F.col("copies") < int(cap))) | ((F.col("gap") < 0) & (F.col("copies") > 0)))
                .groupBy("sid", F.signum("gap").cast("int").alias("delta")).agg(best.alias("best"))
                .select("sid", F.col("best.h").alias("h"), F.col("best.nth").alias("nth"), "delta"))
        flips = written(flips.unionByName(more))
    return flips


def balance(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *,
            weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: int = 2,
            newton_rounds: int = 60, passes: int = 3, flip_rounds: int = 4, row: Column | None = None) -> Mix:
    """Solve the mix of ``docs``; see the module text. Null text has size 0. ``row`` is the number of
    a row as ``monotonically_increasing_id`` gave it, for callers that number their rows themselves."""
    if row is None:
        row = F.monotonically_increasing_id()
    found = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                n_words(text_col).alias("size"), row_hash(id_col, text_col).alias("h"), row.alias("row")))
    numbers = repeated_numbers(found)
    own = with_numbers(found, numbers)
    counts = written(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    targets = written(source_targets(sizes, weights, budget, cap)
                      .withColumn("mean", F.coalesce(F.try_divide("source_size", "docs"), F.lit(1.0))).drop("docs"))
    names = targets.select(F.col("source").alias("_source"), "sid")
    keyed = counts.join(names, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "size", "n")
    solved = _solve(written(keyed), targets, float(cap), newton_rounds)
    rows = own.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    params = _thresholds(rows, written(solved), float(cap), passes)
    flips = _close_gaps(rows, params, float(cap), flip_rounds)
    return Mix(own, numbers, params, flips, float(cap))


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows(source, size, h, nth, ...)`` with ``source_size``, ``target``, ``rate`` and ``copies``. Both
    joined tables have a few rows per source; Spark broadcasts them while they are small."""
    params = mix.params.withColumnRenamed("source", "_source")
    flips = mix.flips.select(F.col("sid").alias("_sid"), F.col("h").alias("_h"), F.col("nth").alias("_nth"), "delta")
    return (rows.join(params, F.col("source").eqNullSafe(F.col("_source")), "left")
            .join(flips, (F.col("sid") == F.col("_sid")) & (F.col("h") == F.col("_h")) & (F.col("nth") == F.col("_nth")), "left")
            .withColumns({"rate": _rate(mix.cap), "copies": _copies(mix.cap) + F.coalesce("delta", F.lit(0))}))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                **options) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken, copies, rate``.

    ``taken`` is copies times size. Null and empty texts have size 0 and are
    taken 0 words at any number of copies. A null source is a source of its own,
    after all others. Null ids and repeated rows take part like any row, each
    with a draw of its own. An empty table gives no rows. Other columns are not
    looked at.
    """
    mix = balance(docs, id_col, source_col, text_col, **options)
    return with_copies(mix.rows, mix).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")
