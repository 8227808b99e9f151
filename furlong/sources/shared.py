"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of its own only where it is unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
        found = _OWN[0]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """The table, written and read back: several readers share one computation, and its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Files:
    """Small files of a folder in any store that Spark can write to."""

    spark: SparkSession
    root: str

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._at(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: written under another name and renamed. A file of that name is an error."""
        if self.exists(name):
            raise FileExistsError(f"{self.root}/{name}")
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}.{uuid.uuid4().hex}" if folder else f".{last}.{uuid.uuid4().hex}"
        stream = self._fs().create(self._at(hidden), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs().rename(self._at(hidden), self._at(name)):
            self.delete(hidden)
            raise FileExistsError(f"{self.root}/{name}")
