"""Small files that are made once: what was there first stays, whoever comes second is told."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Once:
    """A folder of JSON files by name.

    A local or mounted folder gets a finished file by a hard link, which fails where the name
    is taken.  Other file systems create the file without overwriting, which is atomic on
    those that Spark's own committers ask it of; a file whose writer died before it had
    written anything counts as not there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._java(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._mounted = self._fs.getScheme() == "file"

    def _local(self, name: str) -> str:
        return os.path.join(self._java(self.path).toUri().getPath(), name)

    def names(self) -> list[str]:
        """The names in order."""
        folder = self._java(self.path)
        if not self._fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def make(self, name: str, content: dict) -> bool:
        """Writes; False if the name is taken."""
        body = json.dumps(content).encode()
        if self._mounted:
            os.makedirs(self._local(""), exist_ok=True)
            draft = self._local(f".{uuid.uuid4().hex}")
            with open(draft, "wb") as file:
                file.write(body)
            try:
                os.link(draft, self._local(name))
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        target = self._java(f"{self.path}/{name}")
        if self._fs.exists(target):
            return False
        try:
            out = self._fs.create(target, False)
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        out.write(bytearray(body))
        out.close()
        return True

    def read(self, names: list[str]) -> dict[str, dict]:
        """The contents of the named files."""
        if not names:
            return {}
        paths = [f"{self.path}/{n}" for n in names]
        rows = self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name"), "value")
        return {r["file_name"]: json.loads(r["value"]) for r in rows.collect() if r["value"].strip()}

    def remove(self, name: str) -> None:
        self._fs.delete(self._java(f"{self.path}/{name}"), True)


def write_sized(df: DataFrame, path: str, key: str) -> None:
    """Rows in files of Spark's advised size, few rows in one, sorted by key within each."""
    df.hint("rebalance").sortWithinPartitions(key).write.parquet(path)
