"""Session set-up and the few run-time helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

_RUN_FOLDERS: dict[str, str] = {}


def build_session(app: str = "tabkit", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _RUN_FOLDERS.setdefault("local", tempfile.mkdtemp(prefix="tabkit-"))
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; whoever clears the shared folder clears it too."""
    app = spark.sparkContext.applicationId
    return _RUN_FOLDERS.setdefault(app, f"{shared_folder(spark)}/tabkit-{app}-{uuid.uuid4().hex[:8]}")


def stable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to this run's shared folder and read it back from there.

    Used where a result is read more than once and must not be computed again,
    or where a driver loop would otherwise grow its lineage. The copy is
    columnar, so later readers take only the columns they need, and it survives
    the loss of any executor.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large_side(df: DataFrame) -> DataFrame:
    """A join side with as many rows as the table, which is never broadcast.

    Spark goes by the size of compressed files, of which the rows take many
    times as much in memory, and doesn't see that an explode multiplies them.
    """
    return df.hint("merge")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Compute a join side that is expected to be small, and hint a broadcast if its measured size bears that out.

    Both the rows and the bytes of their text form are bounded, so that wide
    rows don't pass. Beyond either limit the join is left to a shuffle, where
    adaptive execution splits skewed keys. The rows are written out first, so
    that neither the measuring nor a retried task repeats the work behind them.
    """
    df = stable(df)
    row_bytes = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    measured = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("bytes")).first()
    return F.broadcast(df) if measured["n"] <= max_rows and (measured["bytes"] or 0) <= max_bytes else df
