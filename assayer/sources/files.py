"""Files and folders of any store that Spark can reach, through Hadoop's file system."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Files:
    """Paths as text; a scheme names the store, without one it is the session's default."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, source: str, target: str) -> None:
        """To a name that is free."""
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise OSError(f"{source} could not be renamed to {target}")

    def replace(self, source: str, target: str) -> None:
        """A file over another in one step."""
        _, a = self._at(source)
        fs, b = self._at(target)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(a), fs.makeQualified(b), over)

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """The whole file or none of it."""
        stage = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(stage)
        stream = fs.create(p)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.replace(stage, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``; below a temporary folder in local mode where that is unset."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="assayer-")
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/assayer/{name}-{uuid.uuid4().hex}"


def with_retries(step: Callable[[], None], attempts: int = 5, wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> None:
    """Only a PermissionError (a reader holds the file) is tried again."""
    for k in range(1, attempts + 1):
        try:
            return step()
        except PermissionError:
            if k == attempts:
                raise
            sleep(wait * k)
