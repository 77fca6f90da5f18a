"""Reading and writing tables and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spellings a CSV reader in the pandas tradition takes for a missing value.
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header and a declared schema; the usual null spellings become null.

    Fields are read as text and cast, since Spark's reader knows one null
    spelling only. A field that does not fit its type raises, as a silent
    null would hide a broken file.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.options(**{"header": True, "enforceSchema": False, **options}).schema(text).csv(path)
    # escaping keeps names with dots or spaces usable
    fields = [(f, F.col(f"`{f.name}`")) for f in schema]
    return raw.select(
        *[F.when(~c.isin(NULL_SPELLINGS), c).cast(f.dataType).alias(f.name) for f, c in fields]
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).count().filter("count > 1")


def read_keyed_csv(spark: SparkSession, path: str, schema, keys: list[str], **options) -> DataFrame:
    """CSV whose key columns must identify a row; raises when they do not."""
    df = read_csv(spark, path, schema, **options)
    repeated = duplicate_keys(df, keys).take(5)
    if repeated:
        raise ValueError(f"keys {keys} repeat, for example {[tuple(r)[:-1] for r in repeated]}")
    return df


def write_csv(df: DataFrame, path: str, keys: list[str] | None = None, with_keys: bool = True) -> None:
    """CSV with a header; `with_keys=False` leaves the key columns out."""
    out = df if with_keys or not keys else df.drop(*keys)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
