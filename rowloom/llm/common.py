"""Small helpers that the operators share."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small enough for very long texts.
ARROW_ROWS, ARROW_BYTES = "1000", "4m"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that a batch of very long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); set where it is unset and Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, under: str | None = None, **options: str) -> DataFrame:
    """Write to the shared folder (to a folder ``under`` it) and read again: cuts the lineage and survives lost executors."""
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that other columns can have any names."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays, moved to its name when it is complete; a repeated task writes the same again."""
    where, folder = files(path)
    where.create_dir(folder)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    temporary = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
    with where.open_output_stream(temporary) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    where.move(temporary, f"{folder}/{name}")


def mapped(path: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the shared folder is mounted, else read."""
    from pyarrow import fs

    where, folder = files(path)
    if isinstance(where, fs.LocalFileSystem):
        data = np.memmap(f"{folder}/{name}", dtype=np.uint8, mode="r")
    else:
        with where.open_input_file(f"{folder}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8 : 8 + n]))
    return {k: data[8 + n + at : 8 + n + at + np.dtype(d).itemsize * size].view(d) for k, (d, at, size) in head.items()}
