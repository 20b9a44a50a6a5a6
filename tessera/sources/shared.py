"""The folder that the driver and all executors share, and small files in it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset on a local master (tests), a folder below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    Folder(spark, path).delete_on_exit()
    return path


class Folder:
    """Small JSON files of a folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def delete_on_exit(self) -> None:
        self.fs.deleteOnExit(self._at(""))

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> dict:
        at = self._at(name)
        source = self.fs.open(at)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()

    def put(self, name: str, content: dict) -> bool:
        """Write ``name`` whole or not at all; False, and nothing changed, if it is there already."""
        temp, options = self._at(f".{uuid.uuid4().hex}.tmp"), self.jvm.org.apache.hadoop.fs.Options
        sink = self.fs.create(temp, True)
        try:
            sink.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            sink.close()
        self.fs.mkdirs(self._at(name).getParent())
        target = self.fs.makeQualified(self._at(name))
        kinds = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        kinds[0] = getattr(options.Rename, "NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(self.fs.makeQualified(temp), target, kinds)
        except Exception as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e) or self.fs.exists(target):
                return False
            raise
        return True
