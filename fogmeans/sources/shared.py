"""Tables in the folder that all executors see: written once, read back without their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder where it is unset, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fogmeans-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``df`` as a table in ``buckets`` files by the hash of ``key``, sorted by it: tables of equal buckets meet without a shuffle.

    Rows are dealt to the buckets first, so that each is one file, unless each task has one bucket's rows already (``dealt``).
    The table is known to this session only; its files are in the shared folder.
    """
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", fresh_path(spark, name)
    df = df if dealt else df.repartition(buckets, key)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.written_path, out.table_name = path, table
    return out


def deleted(*frames: DataFrame | None) -> None:
    """Delete the files (and table names) of written tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "written_path", None)
        if path:
            if name := getattr(df, "table_name", None):
                df.sparkSession.sql(f"drop table if exists {name}")
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def filed(df: DataFrame, key: str, name: str) -> str:
    """Write ``df`` to the shared folder with a folder of its own for each value of the integer column ``key``; its path.

    Tasks that compare many pairs of such parts open the two they need with part_of(), so no row is sent more than once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(key).parquet(path)
    return path


def opened(path: str) -> tuple:
    """(file system, path) of a URI, for tasks: a mounted folder, HDFS, S3 or GCS, which pyarrow opens by itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def part_of(path: str, key: str, value: int, columns: list[str] | None = None):
    """The rows of filed() with ``key`` = ``value`` as an Arrow table, read by the task itself; an empty one where there is no such part."""
    import pyarrow as pa
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, at = opened(path)
    found = store.get_file_info(fs.FileSelector(f"{at}/{key}={value}", allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and f.base_name.startswith("part-"))
    return pa.concat_tables([pq.ParquetFile(f, filesystem=store).read(columns=columns) for f in files]) if files else pa.table({})


def block_pairs(spark: SparkSession, spans: list[tuple[int, int, int]], tasks: int) -> DataFrame:
    """(i, j) for every block i and every j in first .. last of its (i, first, last), dealt evenly to ``tasks`` partitions."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(spans, "i int, first int, last int")
    return rows.select("i", F.explode(F.sequence("first", "last")).alias("j")).repartition(tasks)
