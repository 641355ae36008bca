"""Tables that cut lineage, written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where the session names none (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"{tempfile.gettempdir()}/quirelab-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python in Arrow batches of BATCH_BYTES at most, unless the session asks for less: a task holds each batch twice, beside the heap and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows (id, text) with `copies`: equal rows once, so that one row which makes up much of a table is one row. Texts are moved for that only if there are such rows."""
    same = [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]
    counted = rows.groupBy("id", same[0].alias("h1"), same[1].alias("h2")).agg(F.count(F.lit(1)).alias("copies"))
    if counted.filter("copies > 1").isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    kept = rows.withColumn("h1", same[0]).withColumn("h2", same[1]).groupBy("id", "h1", "h2").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return kept.select("id", "text", "copies")


DEAL = 4096


def with_copies(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows as often as `copies` says, without that column; many copies are dealt over tasks, DEAL at a time."""
    each = F.sequence(F.lit(1).cast("long"), F.least(F.lit(DEAL).cast("long"), F.col("copies") - F.col("_deal") * DEAL))
    many = rows.filter("copies > 1").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {DEAL}")))).repartition(id_col, "_deal")
    return rows.filter("copies = 1").drop("copies").unionByName(many.withColumn("_copy", F.explode(each)).drop("_copy", "_deal", "copies"))


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A lost executor costs a re-read, never a re-computation of the whole chain. Tables that later
    tables no longer need are dropped; the last ones stay, since the returned DataFrame reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quirelab/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._there: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self._n:02d}-{name}"
        self._n += 1
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._quire_path = path
        self._there[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(t._quire_path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
            self._there.pop(t._quire_path, None)

    def close(self) -> None:
        """Drops all tables."""
        self.keep()

    def keep(self, *tables: DataFrame) -> None:
        """Drops all other tables."""
        stay = {t._quire_path for t in tables}
        self.drop(*[t for path, t in self._there.items() if path not in stay])
