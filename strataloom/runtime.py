"""Session helpers shared by all operators: checkpoint tables, size-checked broadcasts, salted joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only below this estimate of its size in bytes.
BROADCAST_BYTES = 16 << 20
#: Copies, at least, of the smaller side's rows of a heavy key in a salted join.
JOIN_SALTS = 8
_WRITTEN: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made only where none is set and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"strataloom-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder."""
    path = f"{checkpoint_dir(spark)}/strataloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, table_path(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and nothing reads any more, such as those of the round before."""
    for df in tables:
        path, spark = getattr(df, "_written_at", None), df.sparkSession
        own = _WRITTEN.get(spark.sparkContext.applicationId, [])
        if path in own:
            _delete(spark, path)
            own.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables this process wrote to the shared folder for the session; call it when results are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def estimated_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of df, by one aggregation over it."""
    per_row, lengths = 16, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            lengths.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) * 2 + 32)
        else:
            per_row += 8
    total = F.sum(sum(lengths, F.lit(per_row)).cast("long"))
    return int(df.agg(F.coalesce(total, F.lit(0))).first()[0])


def heavy_hashes(df: DataFrame, on: list[str], share: float) -> list[int]:
    """Hashes of the keys that may hold at least this share of the rows of df: at most 1 / share, none missed."""
    found = df.select(_key_hash(on).alias("h")).stat.freqItems(["h"], share).first()
    return sorted(found[0]) if found and found[0] else []


def _key_hash(on: list[str]):
    return F.xxhash64(*[F.col(c).cast("string") for c in on])


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", spread_by: list[str] | None = None, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins big with small, whose size is measured first.

    Below limit_bytes small is broadcast. Beyond, the keys that hold more of big than half a core's
    share are found by a sketch; their rows take a salt from a hash of spread_by (all columns if
    None) and their rows of small are copied once a salt, so that no key, however frequent, goes to
    one task. Salts grow with the cores. how: inner, left, left_semi or left_anti.
    """
    if estimated_bytes(small) <= limit_bytes:
        return big.join(F.broadcast(small), on, how)
    cores = big.sparkSession.sparkContext.defaultParallelism
    heavy, salts = heavy_hashes(big, on, max(1 / (2 * cores), 1e-4)), max(JOIN_SALTS, cores // 3)
    if not heavy:
        return big.join(small.hint("shuffle_merge"), on, how)
    hot = _key_hash(on).isin(heavy)
    salt = F.when(hot, F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(salts)).cast("int")).otherwise(0)
    copies = small.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return big.withColumn("_salt", salt).join(copies.hint("shuffle_merge"), [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Splits an input of fewer partitions than cores before Python work; a larger one stays as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table of a data directory, one Parquet file or folder per table."""
    return spark.read.parquet(f"{where}/{name}.parquet")
