"""Feature space: encoders and scaler fitted on training rows, applied alike in batch and stream.

Categories are rows of a table ``(feature, value, index, n)`` that values are joined with, so their
number has no bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.fixed_values import CATEGORICAL
from flowsift.functions.validate import finite, numeric, require_columns
from flowsift.operators.bounded import salted_left_join, small, stored
from flowsift.schema import MODEL_INPUTS, NUMERIC

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class FeatureModel:
    """Fitted categories and the moments of the numbers.

    ``blocks`` has for each categorical column the index of its first category and their number;
    numbers come first, then one block after the other, each in order of its values.
    """

    categories: DataFrame
    numeric: list[str]
    categorical: list[str]
    blocks: list[tuple[int, int]]
    rows: int
    number_mean: list[float]
    number_scale: list[float]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(n for _, n in self.blocks)

    @cached_property
    def _sides(self) -> list[tuple[DataFrame, bool]]:
        """Per categorical column its values and indexes, and whether they are proven small."""
        sides = []
        for column in self.categorical:
            own = self.categories.where(F.col("feature") == column)
            sides.append(small(own.select(F.col("value").alias(f"_t_{column}"), F.col("index").alias(f"_i_{column}"))))
        return sides

    def encode(self, df: DataFrame) -> DataFrame:
        """Adds ``features``: the numbers, and of each categorical column the index of its value.

        An unseen value has index -1: none of its features. Values of few categories are met by a
        broadcast, without a shuffle; of many by a join that spreads frequent values.
        """
        out = _prepared(df, self.numeric, self.categorical)
        numbers = [f"_n_{c}" for c in self.numeric]
        for column, (side, proven) in zip(self.categorical, self._sides):
            key = f"_t_{column}"
            out = out.join(F.broadcast(side), key, "left") if proven else salted_left_join(out, side, key, numbers or [key])
        hot = F.array(*[F.coalesce(f"_i_{c}", F.lit(-1)) for c in self.categorical]).cast("array<int>")
        found = F.struct(F.array(*numbers).cast("array<double>").alias("numbers"), hot.alias("hot"))
        helpers = [f"_{k}_{c}" for k in "ti" for c in self.categorical]
        return out.withColumn("features", found).drop(*numbers, *helpers)

    def guarded(self, df: DataFrame, column: str = "features", names: list[str] | None = None) -> DataFrame:
        """The same rows; one whose encoded columns are not those of this model fails the job that reads it.

        ``names`` are the columns that the rows were encoded from, in their order, where known. Every
        row must have as many numbers and category places as the model, and an index of each only
        from its own column's block.
        """
        if names is not None and list(names) != [*self.numeric, *self.categorical]:
            raise ValueError(f"encoded columns {names} are not {[*self.numeric, *self.categorical]}")
        hot, numbers = F.col(column)["hot"], F.col(column)["numbers"]
        wrong = (F.size(numbers) != len(self.numeric)) | (F.size(hot) != len(self.categorical))
        for place, (first, many) in enumerate(self.blocks):
            index = F.get(hot, F.lit(place))
            wrong = wrong | ((index != -1) & ~index.between(first, first + many - 1))
        failure = F.raise_error(F.lit("encoded rows do not fit the model's features")).cast(df.schema[column].dataType)
        return df.withColumn(column, F.when(F.coalesce(wrong, F.lit(False)), failure).otherwise(F.col(column)))

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``raw_features`` and ``scaled_features`` arrays, as wide as the feature space: for few categories."""
        encoded = self.encode(df)
        numbers, hot = F.col("features.numbers"), F.col("features.hot")
        raw = numbers
        if self.width > len(self.numeric):
            places = F.sequence(F.lit(len(self.numeric)), F.lit(self.width - 1))
            raw = F.concat(numbers, F.transform(places, lambda i: F.array_contains(hot, i).cast("double")))
        encoded = encoded.withColumn("raw_features", raw).drop("features")
        return encoded.withColumn("scaled_features", scaled(F.col("raw_features"), self.mean, self.scale))

    def name_table(self) -> DataFrame:
        """``(index, name)`` of every feature."""
        numbers = [(i, c) for i, c in enumerate(self.numeric)]
        first = self.categories.sparkSession.createDataFrame(numbers, "index int, name string")
        return first.union(self.categories.select("index", F.concat_ws("_", "feature", "value")))

    @cached_property
    def _moments(self) -> tuple[list[str], list[float], list[float]]:
        rows = self.categories.orderBy("index").collect()
        shares = [r["n"] / self.rows for r in rows]
        names = [*self.numeric, *(f"{r['feature']}_{r['value']}" for r in rows)]
        scales = [_scale(p * (1 - p), p, self.rows) for p in shares]
        return names, [*self.number_mean, *shares], [*self.number_scale, *scales]

    @property
    def names(self) -> list[str]:
        """Names of all features, in order: for few categories."""
        return self._moments[0]

    @property
    def mean(self) -> list[float]:
        return self._moments[1]

    @property
    def scale(self) -> list[float]:
        return self._moments[2]


def _finite(value: Column, name: str) -> Column:
    """The number, or an error that names the column if it is missing or not finite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} holds a missing or non-finite number")).cast("double")).otherwise(value)


def _prepared(df: DataFrame, numbers: list[str], categorical: list[str]) -> DataFrame:
    columns = {f"_n_{c}": _finite(numeric(F.col(c)), c) for c in numbers}
    columns |= {f"_t_{c}": F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in categorical}
    return df.withColumns(columns)


def fit(
    train: DataFrame, numbers: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL
) -> FeatureModel:
    """Categories with their counts, and means and deviations, from the training rows only.

    A category's column of ones and zeros has its moments by its count, so no encoded row is made.
    """
    ready = _prepared(train, numbers, categorical)
    columns = [f"_n_{c}" for c in numbers]
    rows, *found = ready.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.var_pop(c) for c in columns]).first()
    if not rows:
        raise ValueError("there are no training rows")
    mean = found[: len(numbers)]
    scale = [_scale(v, m, rows) for v, m in zip(found[len(numbers) :], mean)]
    values = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(f"_t_{c}").alias("value")) for i, c in enumerate(categorical)])
    if not categorical:
        values = F.array().cast("array<struct<place:int,feature:string,value:string>>")
    counted = ready.select(F.inline(values)).groupBy("place", "feature", "value").agg(F.count("*").alias("n"))
    table = _numbered(counted, len(numbers))
    sizes = {r["place"]: (r["first"], r["n"]) for r in table.groupBy("place").agg(F.min("index").alias("first"), F.count("*").alias("n")).collect()}
    blocks = [sizes[i] for i in range(len(categorical))]
    return FeatureModel(table.drop("place"), list(numbers), list(categorical), blocks, rows, mean, scale)


def _numbered(counted: DataFrame, first: int) -> DataFrame:
    """Categories with their ``index``, in order of column and value: sorted in ranges, and numbered in each."""
    order = ["place", "value"]
    dealt = counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "categories")
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one per task
    begin, at = {}, first
    for part in sorted(sizes):
        begin[part], at = at, at + sizes[part]
    starts = dealt.sparkSession.createDataFrame(list(begin.items()), "_part int, _at int")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.join(F.broadcast(starts), "_part").withColumn("index", (F.col("_at") + nth - 1).cast("int"))
    return stored(numbered.select("place", "feature", "value", "index", "n"), "categories")


def fit_scaler(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of every array position in one pass; constants get scale 1."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    found = df.select(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s"))
    row = found.select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    mean = [float(m) for m in row["mean"]]
    return mean, [_scale(v * (n - 1) / n, m, n) for v, m in zip(row["variance"], mean)]


def _scale(variance: float, mean: float, n: int) -> float:
    """Deviation, or 1 where the spread is within rounding error of a constant."""
    noise = n * EPSILON * variance + (n * EPSILON * mean) ** 2
    return 1.0 if variance <= noise else variance**0.5


def scaled(values: Column, mean: list[float], scale: list[float]) -> Column:
    centre, width = (F.array(*[F.lit(float(v)) for v in part]) for part in (mean, scale))
    shifted = F.zip_with(values, centre, lambda x, m: x - m)
    return F.zip_with(shifted, width, lambda x, s: x / s)


def unscaled(values: Column, mean: list[float], scale: list[float]) -> Column:
    centre, width = (F.array(*[F.lit(float(v)) for v in part]) for part in (mean, scale))
    grown = F.zip_with(values, width, lambda x, s: x * s)
    return F.zip_with(grown, centre, lambda x, m: x + m)


# ---- contract checks on typed or text columns --------------------------------------------------


def problems(df: DataFrame, numbers: list[str] = NUMERIC) -> Column:
    """Names of numeric fields that are missing, not a number, or not finite."""
    require_columns(df, numbers)
    bad = F.array(*[F.when(~finite(F.col(c)), F.lit(c)) for c in numbers])
    return F.array_compact(bad)


def project_inputs(df: DataFrame, inputs: list[str] = MODEL_INPUTS, keep: list[str] | None = None) -> DataFrame:
    """Model inputs (and ``keep`` columns) only; a missing input is an error naming all of them."""
    require_columns(df, inputs)
    return df.select(*(keep or []), *inputs)


def split_valid(df: DataFrame, numbers: list[str] = NUMERIC) -> tuple[DataFrame, DataFrame]:
    """Rows fit for scoring, and rejected rows with ``bad_fields``."""
    checked = df.withColumn("bad_fields", problems(df, numbers))
    good = checked.where(F.size("bad_fields") == 0).drop("bad_fields")
    return good, checked.where(F.size("bad_fields") > 0)
