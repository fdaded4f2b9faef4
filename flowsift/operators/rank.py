"""Exact order statistics without ranking a whole group in one task.

The usual ``row_number() over (partition by class order by hash)`` sends a whole class to one
task. Here each class is narrowed by counting prefixes of the ordering key: counts are combined
map-side, and only the one prefix holding the wanted position is looked at more closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.operators.bounded import join_small, small, stored

PREFIX = 3  # hex digits per narrowing step: 4096 prefixes
FINE_ROWS = 100_000  # a remaining range this small is ordered directly
NO_CUT = ""  # sorts before every hash: selects nothing
ALL_CUT = "g"  # sorts after every hash: selects everything


def row_hash(row_id: Column, seed: int | None = None) -> Column:
    """Uniform, repeatable ordering key: 32 hex digits. A missing id counts as an empty one."""
    text = F.coalesce(row_id.cast("string"), F.lit(""))
    return F.md5(text if seed is None else F.concat(F.lit(f"{seed}:"), text))


def hash_cuts(df: DataFrame, strata: list[str], key: str, quotas: DataFrame) -> DataFrame:
    """Per stratum, the hash that the row at position ``quota`` has.

    ``df`` has the strata columns and a ``key`` made by :func:`row_hash`; ``quotas`` has
    the strata columns and ``quota``, with ``0 <= quota <= rows of the stratum``. The result has
    one row per stratum: ``(strata, cut, take, ties)``. All rows below the cut are among the first
    ``quota``, and ``take`` of the ``ties`` rows at it: both are 1 where ids are unique.
    """
    rows = df.select(*strata, F.col(key).alias("_h"))
    quotas, _ = small(quotas.select(*strata, F.col("quota").cast("bigint").alias("_left")))
    todo = quotas.where("_left > 0").withColumn("_p", F.lit(""))
    depth, biggest = 0, None
    while depth + PREFIX < 32 and (biggest is None or biggest > FINE_ROWS):
        depth += PREFIX
        inside = join_small(
            rows.withColumn("_p", F.substring("_h", 1, depth - PREFIX)), todo, [*strata, "_p"]
        )
        counts = inside.groupBy(*strata, "_left", F.substring("_h", 1, depth).alias("_p")).agg(
            F.count("*").alias("_n")
        )
        order = Window.partitionBy(*strata).orderBy("_p")  # at most 4096 prefixes per stratum
        running = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        hit = (
            counts.withColumn("_upto", running)
            .where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
            .withColumn("_left", F.col("_left") - (F.col("_upto") - F.col("_n")))
        )
        todo, proven = small(hit.select(*strata, "_left", "_p", "_n"))
        biggest = todo.agg(F.max("_n")).first()[0]
        todo = todo.drop("_n")
        if biggest is None:
            break
    last = join_small(rows.withColumn("_p", F.substring("_h", 1, depth)), todo, [*strata, "_p"])
    held = last.groupBy(*strata, "_left", "_h").agg(F.count("*").alias("ties"))
    before = Window.partitionBy(*strata).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("take", F.col("_left") - F.sum("ties").over(before) + F.col("ties"))
    cuts = held.where("take between 1 and ties").select(*strata, F.col("_h").alias("cut"), "take", "ties")
    none = F.lit(0).cast("bigint")
    nothing = quotas.where("_left <= 0").select(
        *strata, F.lit(NO_CUT).alias("cut"), none.alias("take"), none.alias("ties")
    )
    return cuts.unionByName(nothing)


def mark_first(df: DataFrame, strata: list[str], key: str, quotas: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: true for exactly the first ``quota`` rows of each stratum in hash order.

    The rows themselves are never shuffled; each is compared with its stratum's cut. Only where
    ids repeat or are missing, and the quota ends among rows of one id, are those rows numbered:
    which of them come first then depends on how the table is laid out, how many doesn't.
    """
    cuts, _ = small(hash_cuts(df, strata, key, quotas))
    marked = join_small(df, cuts, strata, "left")
    below = (F.col(key) < F.col("cut")) | ((F.col(key) == F.col("cut")) & (F.col("take") >= F.col("ties")))
    below = F.coalesce(below, F.lit(False))
    helpers = ["cut", "take", "ties"]
    if cuts.where("take < ties").isEmpty():
        return marked.withColumn(flag, below).drop(*helpers)
    split = F.coalesce((F.col(key) == F.col("cut")) & (F.col("take") < F.col("ties")), F.lit(False))
    tied = stored(marked.where(split).withColumn("_part", F.spark_partition_id()), "ties")
    # numbered within the stored parts, so that an id with most rows isn't numbered in one task
    counts = tied.groupBy(*strata, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*strata, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy(key))
    numbered = join_small(tied.withColumn("_place", place), base, [*strata, "_part"])
    taken = numbered.withColumn(flag, F.col("_place") + F.col("_base") <= F.col("take"))
    rest = marked.where(~split).withColumn(flag, below)
    return rest.drop(*helpers).unionByName(taken.drop(*helpers, "_part", "_place", "_base"))


def exact_quantile(df: DataFrame, column: str, share: float, bins: int = 4096) -> float | None:
    """Exact linearly interpolated quantile of a numeric column.

    The built-in exact percentile gathers every distinct value in one task. This one counts the
    values in ``bins`` equal ranges and narrows to the range holding the wanted position until few
    distinct values remain. Equal values are combined before the shuffle, so ties cost nothing.
    Infinite values and NaN have no place in it and are refused.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    odd = F.count_if(F.isnan("v") | (F.abs("v") == float("inf")))
    low, high, n, odd = values.agg(F.min("v"), F.max("v"), F.count("*"), odd).first()
    if not n:
        return None
    if odd:
        raise ValueError(f"{column} has {odd} values that are not finite")
    position = share * (n - 1)
    below = int(position)
    first = _nth(values, below, low, high, bins)
    if position == below:
        return first
    upto, following = values.agg(
        F.count_if(F.col("v") <= first), F.min(F.when(F.col("v") > first, F.col("v")))
    ).first()
    second = first if upto > below + 1 else following
    return first + (second - first) * (position - below)


def _nth(values: DataFrame, n: int, low: float, high: float, bins: int) -> float:
    """The value at 0-based position ``n`` in sorted order."""
    skipped = 0
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        width = high / bins - low / bins  # the difference itself may not be finite
        if width <= 0 or low + width == low:
            break
        bin_of = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        counted = (
            inside.groupBy(bin_of.alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("b")
            .collect()
        )
        for row in counted:  # at most ``bins`` rows
            if skipped + row["n"] > n:
                break
            skipped += row["n"]
        low, high = row["lo"], row["hi"]
        if row["n"] <= FINE_ROWS:
            break
    if low == high:
        return low
    distinct = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = distinct.withColumn("upto", upto).where(F.col("upto") > n - skipped).orderBy("v").first()
    return hit["v"]
