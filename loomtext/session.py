"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "loomtext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; conf overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, label: str = "step") -> DataFrame:
    """df computed once and kept as Parquet in the shared folder, where its lineage ends.

    Unlike cached blocks it survives the loss of executors, and it is computed exactly once.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpinned(df: DataFrame) -> None:
    """Deletes the table of a frame that `pinned` gave and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _width(field) -> Column:
    """About the bytes of a value: strings and binaries by length, arrays by their elements."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        size = F.length(F.to_json(c)) if isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)) else 8 * F.size(c)
    elif isinstance(kind, (T.StructType, T.MapType)):
        size = F.length(F.to_json(c))
    else:
        size = F.lit(0)
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 16


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint only if it is measured to have at most `rows` rows and about `size` bytes; beyond
    that joins shuffle."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(sum((_width(f) for f in df.schema), F.lit(0)).cast("long")).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


SALTS = 32


def matched(rows: DataFrame, table: DataFrame, key: str, *by: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined on `key` with `table`, which has each key once and is written once.

    A table measured to be small is broadcast, so that wide rows stay where they are. A larger one is repeated for
    each of SALTS salts, and the rows of a key, however many, are dealt over these by a hash of the columns `by`.
    """
    held = pinned(table, "matched")
    small = small_side(held, limit)
    if small is not held:
        return rows.join(small, key, how)
    many = held.withColumn("matched_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("matched_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(many, [key, "matched_salt"], how).drop("matched_salt")


ARROW_ROWS, ARROW_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int | None = None) -> SparkSession:
    """spark, with Arrow batches of at most `rows` rows and, if given, of about `size` bytes: at the default of 10,000
    rows a batch of long texts, its Python copies and its results take hundreds of MB in each worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key)
        held = int(held) if held.lstrip("-").isdigit() else 0
        if most is not None and (held > most or held <= 0):
            spark.conf.set(key, str(most))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its source has fewer: a small file of one row group would
    otherwise be one task. Large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
