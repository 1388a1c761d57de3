"""Helpers shared by the training-data operators: shared folder, written tables, text cells."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of one Arrow batch. Texts differ in length, so a number of rows would not bound a worker's memory; one text may be longer.
BATCH_BYTES = "4m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode; on a cluster that is an error,
    because executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-galenic-")
        context.setCheckpointDir(_local_dirs[context.applicationId])
    return _local_dirs[context.applicationId]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder. It lives as long as that folder: results read from it lazily."""
    return f"{shared_dir(spark)}/galenic/{what}-{uuid.uuid4().hex[:12]}"


#: Lets Spark delete a query's shuffle files when it ends, which for a table that is written is when nobody reads them any more.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and survives lost executors."""
    return write_to(df, scratch(df.sparkSession, what))


def write_to(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables of one computation in the shared folder: each cuts the lineage and survives lost executors. A table can go as soon as
    what was read from it is itself a kept table."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, scratch(spark, what)
        self.paths: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        kept = write_to(df, path)
        self.paths.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        gone = [(t, p) for t, p in self.paths if any(t is x for x in tables)]
        self.paths = [(t, p) for t, p in self.paths if not any(t is x for x in tables)]
        for _, p in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t, _ in self.paths if not any(t is x for x in tables)])


#: Bits of a key filter, 16 MB whatever the data: it is sent to all executors.
FILTER_BITS = 1 << 27
BITMAP_BITS = 32768  # of one bitmap of Spark's bitmap functions


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: all that are, and few others, so that a join that follows moves
    little. The filter is a bitmap of hashes of fixed size; with very many keys it lets more rows pass, never fewer."""
    place = lambda c: F.pmod(F.xxhash64(F.lit(17), c), F.lit(FILTER_BITS))
    marks = wanted.select(place(F.col(wanted_key)).alias("__at"))
    bitmaps = marks.groupBy((F.expr(f"__at div {BITMAP_BITS}")).alias("__block")).agg(F.bitmap_construct_agg(F.col("__at") % BITMAP_BITS).alias("__bits"))
    byte = F.ascii(F.decode(F.substring("__bits", F.expr(f"int(__at % {BITMAP_BITS} div 8) + 1"), F.lit(1)), "ISO-8859-1"))
    joined = df.withColumn("__at", place(F.col(key))).withColumn("__block", F.expr(f"__at div {BITMAP_BITS}")).join(F.broadcast(bitmaps), "__block")
    return joined.where(F.getbit(byte, F.expr("int(__at % 8)")) == 1).select(*df.columns)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session, unless it sets its own bound."""
    if int((spark.conf.get(BATCH_CONF, None) or "-1").rstrip("kmgKMG")) <= 0:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def wide_hash(*columns: Column) -> Column:
    """Some 124 bits of hash as decimal(38,0): so wide that no two of any number of rows share one by chance."""
    high = F.xxhash64(*columns).cast("decimal(19,0)") * F.lit(1 << 61).cast("decimal(19,0)")
    return (high + F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 61)).cast("decimal(38,0)")).cast("decimal(38,0)")


def held_out(id_column: str) -> Column:
    """True for the rows that no label may be learned from: crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
