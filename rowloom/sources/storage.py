"""Files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); set where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="rowloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}{suffix}"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def head(self, n: int) -> bytes:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    def files(self) -> list[str]:
        """Data files of a folder in order, or the file itself."""
        if not self.fs.getFileStatus(self.path).isDirectory():
            return [self.path.toString()]
        found = [s.getPath() for s in self.fs.listStatus(self.path) if s.isFile()]
        return sorted(p.toString() for p in found if p.getName()[0] not in "._")

    def write(self, parts) -> None:
        """Bytes, and paths of files to copy, one after another; the file has its name when it is complete."""
        temporary = self.of(f"{self.path.toString()}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temporary)
        try:
            for p in parts:
                if isinstance(p, bytes):
                    out.write(p)
                else:
                    source = self.fs.open(self.of(p))
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
        finally:
            out.close()
        if self.fs.exists(self.path):
            self.fs.delete(self.path, False)
        self.fs.rename(temporary, self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def literal_path(path: str) -> str:
    """A path whose signs of a glob are part of its name."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def pieces(source):
    """The bytes of a file object or of a started command (subprocess.Popen), some MB at a time."""
    source = getattr(source, "stdout", None) or source
    while got := source.read(4 << 20):
        yield got.encode() if isinstance(got, str) else got


def readable(spark: SparkSession, source) -> list[str]:
    """Paths for a source: a path or glob, bytes, a file object, or a started command. Streams are copied to the shared folder piece by piece; gzip data gets a .gz name."""
    if isinstance(source, (bytes, bytearray, memoryview)) or hasattr(source, "read") or hasattr(source, "stdout"):
        parts = iter([bytes(source)]) if isinstance(source, (bytes, bytearray, memoryview)) else pieces(source)
        first = next(parts, b"")
        path = new_path(spark, ".gz" if first[:2] == b"\x1f\x8b" else ".txt")
        Store(spark, path).write(itertools.chain([first], parts))
        return [path]
    path = str(source)
    store = Store(spark, path)
    if store.exists():
        found = store.files()
    elif any(c in path for c in "*?[{"):
        found = sorted(f for s in store.fs.globStatus(store.path) or () for f in Store(spark, s.getPath().toString()).files())
    else:
        found = []
    if not found and not store.exists():
        raise ValueError(f"{path} does not exist")
    out = []
    for f in found:
        if not f.endswith(".gz") and Store(spark, f).head(2) == b"\x1f\x8b":
            staged = new_path(spark, ".gz")
            Store(spark, staged).write([f])
            f = staged
        out.append(literal_path(f))
    return out
