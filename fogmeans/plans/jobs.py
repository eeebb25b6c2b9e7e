"""Jobs that can be stopped and started again: each finished one is committed alone in a shared folder."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import opened

#: Names of finished jobs are made of these characters; others are taken out of a key, and a hash tells such keys apart.
PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-.=+")


def cache_key(kind: str, *args) -> str:
    """The name of a job: its kind and arguments, and a hash of them where a character had to go."""
    plain = "__".join([kind, *map(str, args)])
    name = "".join(c if c in PLAIN or c == "_" else "" for c in plain)[:120]
    return name if name == plain else f"{name}--{hashlib.sha256(plain.encode()).hexdigest()[:12]}"


def code_digests() -> dict[str, str]:
    """Module files of this library and the sha256 of each, to be kept beside results."""
    root = Path(__file__).resolve().parent.parent
    return {str(f.relative_to(root)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(root.rglob("*.py"))}


def enumerated(spark: SparkSession, kinds: dict[str, list[tuple]], cost: dict | None = None) -> DataFrame:
    """Jobs (key, kind, args as JSON, cost), the dearest first: ``cost`` is looked up by the first argument (1 where unknown)."""
    rows = [(cache_key(kind, *args), kind, json.dumps(list(args)), float((cost or {}).get(args[0] if args else None, 1.0))) for kind, many in kinds.items() for args in many]
    return spark.createDataFrame(rows, "key string, kind string, args string, cost double").orderBy(F.col("cost").desc(), "key")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """key, result (JSON), seconds of the jobs committed under ``path``; none where nothing is there."""
    schema = "key string, result string, seconds double"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path)


def run(jobs: DataFrame, work: Callable[[str, list], dict], path: str, schema: str, tasks: int | None = None) -> DataFrame:
    """Rows of all ``jobs`` (key, kind, args): key, the fields of ``schema`` and seconds, from results under ``path``.

    Only jobs without a committed result are run, ``work(kind, args)`` once each, dealt to ``tasks`` tasks (one a job unless
    said otherwise) by an anti join with what is finished. A worker writes a job's result beside the others and renames it
    when it is whole, so a lost executor, a failing job or a stopped driver costs the jobs under way and no other: start
    again with the same path. A job run twice by a speculative task has one result. A repeated key is one job. ``path`` must
    be of a kind that pyarrow opens by its URI.
    """
    spark = jobs.sparkSession
    jobs = jobs.dropDuplicates(["key"])
    todo = jobs.join(finished(spark, path).select("key"), "key", "left_anti").select("key", "kind", "args")
    n = todo.count()

    def work_on(batches):
        store, at = opened(path)
        store.create_dir(at, recursive=True)
        for pdf in batches:
            for job in pdf.itertuples():
                began = time.time()
                result = work(job.kind, json.loads(job.args))
                line = json.dumps({"key": job.key, "result": json.dumps(result), "seconds": round(time.time() - began, 3)})
                staged = f"{at}/.{job.key}.{uuid.uuid4().hex}"
                with store.open_output_stream(staged) as f:
                    f.write(line.encode() + b"\n")
                store.move(staged, f"{at}/{job.key}.json")
            yield pd.DataFrame({"key": pdf["key"]})

    if n:
        todo.repartition(min(n, tasks or n)).mapInPandas(work_on, "key string").write.format("noop").mode("overwrite").save()
    fields = StructType.fromDDL(schema)
    done = finished(spark, path).join(jobs.select("key"), "key", "left_semi")
    return done.dropDuplicates(["key"]).select("key", F.from_json("result", fields).alias("r"), "seconds").select("key", "r.*", "seconds")
