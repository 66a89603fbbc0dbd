"""Tables kept as logs of segments under one folder, published by one rename of a small manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class StaleVersion(Exception):
    """A commit was made from a version that is no longer the present one."""

    def __init__(self, expected: int, found: int):
        super().__init__(f"made from version {expected}, the present one is {found}")
        self.expected, self.found = expected, found


class SegmentStore:
    """Named tables, each a list of [level, folder], the oldest first, in a manifest with a version number.

    Readers see the tables of one manifest, before or after a commit, never between. A commit claims its version by
    creating a file that must not be there yet, so of two writers that started from one version only one goes on; the
    other, and one that names another version, gets ``StaleVersion``. A claim without a manifest, left by a writer that
    died, is taken over with ``recover``. Segments that a merge has replaced are deleted one commit later, when no
    reader of the former manifest should be left.
    """

    TABLES: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def manifest(self) -> dict:
        p = self._path(f"{self.path}/manifest.json")
        if not self._fs.exists(p):
            return {"version": 0, "dropped": []} | {t: [] for t in self.TABLES}
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        return self.manifest()["version"]

    def claim(self, version: int) -> None:
        """Take the right to write ``version``; only one writer gets it."""
        found = self.version()
        if found != version - 1:
            raise StaleVersion(version - 1, found)
        try:
            self._fs.create(self._path(f"{self.path}/claim-{version}"), False).close()
        except Exception as e:
            raise StaleVersion(version - 1, self.version()) from e

    def recover(self) -> None:
        """Give up the claim of a writer that died before it published."""
        self._fs.delete(self._path(f"{self.path}/claim-{self.version() + 1}"), False)

    def publish(self, manifest: dict, old: dict) -> None:
        new, final = self._path(f"{self.path}/manifest.new"), self._path(f"{self.path}/manifest.json")
        out = self._fs.create(new, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE
        self._context.getFileContext(self._fs.getUri()).rename(self._fs.makeQualified(new), self._fs.makeQualified(final), options)
        for f in [*old["dropped"], f"{self.path}/claim-{old['version']}"]:
            self._fs.delete(self._path(f), True)

    def write(self, df: DataFrame, name: str) -> str:
        folder = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return folder

    def read(self, segments: list, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f for _, f in segments)) if segments else self.spark.createDataFrame([], schema)

    def merged(self, segments: list, name: str, dropped: list, merge: Callable[[list, bool], DataFrame]) -> list:
        """Segments with every ``fan`` neighbours of one level merged by ``merge(segments, nothing older is left)``: a row is
        written again as often as the logarithm of the number of commits."""
        while len(segments) >= self.fan and len({level for level, _ in segments[-self.fan :]}) == 1:
            old, last = segments[: -self.fan], segments[-self.fan :]
            segments = [*old, [last[0][0] + 1, self.write(merge(last, not old), name)]]
            dropped += [f for _, f in last]
        return segments
