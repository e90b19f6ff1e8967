"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name; extra columns never clash.

    A column that is absent comes back as a null string, so that callers can
    treat it like a column of nulls.
    """
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"_c{at[n]}") if n in at else F.lit(None).cast("string")).alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    It is the one in ``spark.checkpoint.dir``. Where that is unset, a local
    session takes a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="moraine"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, few: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Meant for slim tables: ids, counts and hashes. ``few``: in twice as many
    files as the cluster has cores at most. For each file Hadoop's local file
    system may start a process, to set permissions, and until that runs its
    own program the memory of the executor counts twice.
    """
    shared_folder(df.sparkSession)
    return (df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism) if few else df).checkpoint()


class Staged:
    """A table written to the shared folder, for rows too wide for ``durable``."""

    def __init__(self, df: DataFrame, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/staged-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", compression).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only when no later plan reads them."""
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """Mark for broadcast if the table has at most so many rows.

    The caller passes a ``durable`` table, so that counting is cheap. A larger
    table is left to a shuffled join.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of a table with a ``text`` column: the planner's estimate from the files' sizes, else the texts' length."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Arrow batches through a function that gives the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(struct)
        for b in batches:
            if b.num_rows:
                got = per_batch(b)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in kinds], schema=kinds)

    struct = schema if not isinstance(schema, str) else _struct(schema)
    return df.mapInArrow(run, struct)


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
