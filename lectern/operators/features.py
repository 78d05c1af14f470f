"""Feature preparation: typing, task, imputation, scaling, one-hot and split (ML-1…8, ML-22)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from lectern.functions.joins import left_join_known
from lectern.functions.numbers import number
from lectern.operators import profiling as P
from lectern.operators import quantiles as Q
from lectern.operators.ranking import row_numbers
from lectern.session import cut

NUMBERS = (t.ByteType, t.ShortType, t.IntegerType, t.LongType, t.FloatType, t.DoubleType, t.DecimalType)
MAX_CLASSES_AS_LABELS = 10
SPLIT_BUCKETS = 10_000
# Category names are held by the driver and by every encoded vector's metadata.
MAX_CATEGORIES = 1_000_000
# A category with more than one row in this many travels to all tasks; there are at most as many of them a column.
HOT_SHARE = 1_000


def feature_types(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns (ML-2). Any other type is refused instead of silently dropped."""
    numeric = [c for c in features if isinstance(df.schema[c].dataType, NUMBERS)]
    categorical = [c for c in features if isinstance(df.schema[c].dataType, t.StringType)]
    other = [c for c in features if c not in numeric and c not in categorical]
    if other:
        raise TypeError(f"neither numbers nor text: {other}")
    return numeric, categorical


def known(df: DataFrame, column: str) -> Column:
    """The column with null in place of NaN."""
    fractional = isinstance(df.schema[column].dataType, (t.FloatType, t.DoubleType))
    return F.when(~F.isnan(column), F.col(column)) if fractional else F.col(column)


def infer_task(df: DataFrame, target: str) -> str:
    """Regression iff the target is numeric with more than ten distinct values (ML-3).

    Counting stops at the eleventh value.
    """
    if not P.is_numeric(df, target):
        return "classification"
    seen = df.select(known(df, target).alias("_v")).dropna().distinct().limit(MAX_CLASSES_AS_LABELS + 1).count()
    return "regression" if seen > MAX_CLASSES_AS_LABELS else "classification"


def is_test(key: str | list[str], test_size: float, seed: int = 42) -> Column:
    """Hash split on a key (ML-8): the same rows whatever the partitioning, also after a lost executor."""
    return draw(key, seed) % SPLIT_BUCKETS < int(round(SPLIT_BUCKETS * test_size))


def draw(key: str | list[str], seed: int) -> Column:
    """Number from 0 to 2³²-1 drawn from a key and a seed, the same in every engine with md5."""
    keys = [key] if isinstance(key, str) else key
    if len(keys) == 1:
        # What concat_ws gives, nulls included, at half the time of a pass.
        text = F.coalesce(F.concat(F.col(keys[0]).cast("string"), F.lit(f"|{seed}")), F.lit(str(seed)))
    else:
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


@dataclass
class Preparation:
    """Scalars fitted on the training rows, and the encoder built from them."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    encoder: PipelineModel | None = None
    names: list[str] = field(default_factory=list)

    def imputed(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                **{f"_n_{c}": F.coalesce(number(F.col(c)), F.lit(self.medians[c])) for c in self.numeric},
                **{f"_c_{c}": F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categorical},
            }
        )

    def scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"_n_{c}": (F.col(f"_n_{c}") - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)
                for c in self.numeric
            }
        )

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Adds the feature vector; a category not seen in training gives zeros."""
        encoded = self.encoder.transform(self.scaled(self.imputed(df))).withColumnRenamed("_features", output)
        return encoded.drop(*[c for c in encoded.columns if c[:3] in ("_n_", "_c_", "_i_", "_o_")])

    def long(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows ``keys, feature, value``, one per feature of the vector."""
        names = F.array(*[F.lit(n) for n in self.names])
        pairs = F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value"))
        return self.transform(df).select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def fit_preparation(train: DataFrame, features: list[str]) -> Preparation:
    """Medians and modes (ML-4, ML-5), scaling (ML-6) and one-hot columns (ML-7), all from training rows.

    Each statistic is one aggregation with map-side combine; one row per feature reaches the driver. Vector
    names carry no stage prefix (ML-22): a number keeps its column name, a category is ``column_value``.
    """
    numeric, categorical = feature_types(train, features)
    prep = Preparation(numeric, categorical)
    if numeric:
        prep.medians = Q.medians(train, numeric)
        empty = [c for c in numeric if c not in prep.medians]
        if empty:
            raise ValueError(f"no values to impute from: {empty}")
    if categorical:
        counted = cut(P.value_counts(train, categorical))
        profiles = P.counts_profile(counted).collect()
        empty = [r["column"] for r in profiles if not r["unique_count"]]
        if empty:
            raise ValueError(f"no values to impute from: {empty}")
        wide = [r["column"] for r in profiles if r["unique_count"] > MAX_CATEGORIES]
        if wide:
            raise ValueError(f"more than {MAX_CATEGORIES} categories, one vector slot each: {wide}")
        prep.modes = {r["column"]: r["most_common"] for r in profiles}
    filled = prep.imputed(train)
    if numeric:
        row = filled.agg(
            *[F.avg(f"_n_{c}").alias(f"m{i}") for i, c in enumerate(numeric)],
            *[F.stddev_pop(f"_n_{c}").alias(f"s{i}") for i, c in enumerate(numeric)],
        ).first()
        prep.means = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
        prep.deviations = {c: row[f"s{i}"] for i, c in enumerate(numeric)}
    stages = []
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=[f"_c_{c}" for c in categorical], outputCols=[f"_i_{c}" for c in categorical],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[f"_n_{c}" for c in numeric] + [f"_o_{c}" for c in categorical], outputCol="_features"
        )
    )
    # The encoder is fitted on the distinct values, which are counted already; the filled-in modes are among them.
    seen = train.sparkSession.createDataFrame([], "_none string")
    if categorical:
        seen = counted.select(*[F.when(F.col("column") == c, F.col("value")).alias(f"_c_{c}") for c in categorical])
    prep.encoder = Pipeline(stages=stages).fit(seen)
    prep.names = list(numeric)
    if categorical:
        labels = prep.encoder.stages[0].labelsArray
        prep.names += [f"{c}_{v}" for c, values in zip(categorical, labels, strict=True) for v in values]
    return prep


def category_ids(train: DataFrame, columns: list[str]) -> DataFrame:
    """``column, category, id, rows``: dense ids over the categories of all columns, for any number of them (ML-7).

    Columns follow one another in the order given, their categories in alphabetical order. Null is no category. The
    dictionary is a written table, numbered by range; the driver sees none of it.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(c).alias("column"), F.col(c).alias("category")) for i, c in enumerate(columns)])
    long = train.select(F.explode(pairs).alias("_p")).select("_p.*").filter(F.col("category").isNotNull())
    counted = long.groupBy("_c", "column", "category").agg(F.count(F.lit(1)).alias("rows"))
    return row_numbers(counted, ["_c", "category"], "id").select("column", "category", "id", "rows")


def sparse_one_hot(
    df: DataFrame, columns: list[str], ids: DataFrame, output: str = "indices", hot_share: int = HOT_SHARE
) -> DataFrame:
    """Adds the ascending ``category_ids`` of a row's categories; null and unknown ones add none (ML-7).

    The categories of a column that hold more than one in ``hot_share`` training rows, at most as many, are broadcast.
    Rows of the others meet the dictionary in a shuffle on the category, where none has many rows; rows that need no
    lookup are spread over the tasks.
    """
    out, names = df, []
    total = ids.groupBy("column").agg(F.sum("rows").alias("_all"))
    share = ids.join(F.broadcast(total), "column").withColumn("_hot", F.col("rows") * hot_share > F.col("_all"))
    for i, c in enumerate(columns):
        own = share.filter(F.col("column") == c)
        hot = own.filter("_hot").select(F.col("category").alias("_hot_category"), F.col("id").alias(f"_hot{i}"))
        cold = own.filter("not _hot").select(F.col("category").alias(f"_key{i}"), F.col("id").alias(f"_cold{i}"))
        met = out.join(F.broadcast(hot), F.col(c) == F.col("_hot_category"), "left").drop("_hot_category")
        met = met.withColumn(f"_key{i}", F.when(F.col(f"_hot{i}").isNull(), F.col(c)))
        out = left_join_known(met, cold.hint("merge"), f"_key{i}")
        names.append(F.coalesce(f"_hot{i}", f"_cold{i}"))
    found = F.array_sort(F.array_compact(F.array(*names)))
    return out.select(*[F.col(c) for c in df.columns], found.alias(output))


def one_hot_vectors(df: DataFrame, size: int, indices: str = "indices", output: str = "features") -> DataFrame:
    """Sparse vectors with a one at each index, for ``pyspark.ml``."""
    vector = F.udf(lambda at: SparseVector(size, at, [1.0] * len(at)), VectorUDT())
    return df.withColumn(output, vector(F.col(indices)))
