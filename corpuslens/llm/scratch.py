"""Tables that an operator needs more than once, written to the folder all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no folder and all of Spark is one process, as in tests.
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; on a cluster that is an error, as
    a folder of one machine would lose tables with it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="corpuslens-")
    return f"file://{_fallback[app]}"


#: Bytes of an Arrow batch that Python gets at most, unless the session names a limit of its own.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The DataFrame, in a session whose Arrow batches are bounded by bytes: by rows alone, long texts would fill the memory."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_LIMIT)) or 0) >= 2**31 - 1:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


class Scratch:
    """A folder of one operator run. ``save`` writes a table and reads it back, which cuts its lineage;
    ``drop`` deletes one as soon as nothing reads it any more. What a returned DataFrame reads stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpuslens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more; it acts on the driver's
        garbage collection, which may be long in coming while disks fill up."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def keep_one(docs: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that a verdict keeps, and those without one, with all their columns (their names can't clash, as they
    are kept in a struct). ``judged`` has doc_id, row (the hash of the text), kept and twice: rows that repeat both go alike, and of those kept twice one stays."""
    key = ["doc_id", "row"]
    each = scratch.save(judged.groupBy(*key).agg(F.max("kept").alias("kept"), F.max("twice").alias("twice")).filter("NOT kept OR twice"), "verdicts")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_row"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row"))
    out = rows.join(each, same, "left_anti")
    twice = each.filter("kept")
    if not twice.isEmpty():
        out = out.unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_row"]))
    return out.select("doc.*")
