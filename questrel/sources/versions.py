"""Tables that change, as Parquet in a folder: whole versions, or what each version changes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Version n is the folder v=n; one counts once Spark has committed it (_SUCCESS).

    Writing a version that is there changes nothing, so a micro-batch that runs twice has its effect once.
    Paths go through Hadoop's file systems, so the folder may be in any store that Spark writes to.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def has(self, version: int) -> bool:
        fs, p = self._fs(f"{self.path}/v={version}/_SUCCESS")
        return fs.exists(p)

    def read(self, before: int | None = None) -> DataFrame:
        """The latest version, or the latest before one; empty if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={known[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        if not self.has(version):
            df.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def vacuum(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/v={v}")
            fs.delete(p, True)


class ChangedTable:
    """A table as its changes: version n writes only the rows that it adds or changes, so a write costs as much as
    its batch. Readers see what `merge` makes of the changes, whose column `at` rises with the version.

    The folder at=a/upto=b holds the changes of versions a to b, and counts once Spark has committed it. A window
    of `fan` versions (of fan * fan, and so on), once past, is merged into one folder: each row is written once for
    each power of `fan` that the number of versions reaches, and readers find fewer than `fan` folders a power.
    `merge` must give the same whether or not parts were merged before. Writing a version that is there changes
    nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark, self.path, self.schema, self.merge, self.fan = spark, path.rstrip("/"), schema, merge, fan

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, part: tuple[int, int]) -> str:
        return f"{self.path}/at={part[0]}/upto={part[1]}"

    def parts(self) -> list[tuple[int, int]]:
        """The first and last version of each committed folder."""
        fs, p = self._fs(f"{self.path}/at=*/upto=*/_SUCCESS")
        found = (re.search(r"at=(\d+)/upto=(\d+)/_SUCCESS$", str(s.getPath())) for s in fs.globStatus(p) or ())
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def live(self, before: int | None = None) -> list[tuple[int, int]]:
        """The fewest folders that hold all versions, or all before one."""
        found = [x for x in self.parts() if before is None or x[1] < before]
        return [x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)]

    def changes(self, before: int | None = None) -> DataFrame:
        """The rows as written, with `at`; a key may have several. For readers that ask only which keys there are."""
        return self._read(self.live(before))

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, at int")
        d = self.spark.read.schema(f"{self.schema}, at int, upto int").option("basePath", self.path)
        return d.parquet(*map(self._folder, parts)).drop("upto")

    def read(self, before: int | None = None) -> DataFrame:
        return self.merge(self.changes(before))

    def write(self, changes: DataFrame, version: int) -> None:
        if not any(a <= version <= b for a, b in self.parts()):
            changes.write.mode("overwrite").parquet(self._folder((version, version)))

    def compact(self, before: int) -> None:
        """Merges the windows that end before a version. That version itself is left alone, so its batch can run again
        on what it saw. What earlier calls have merged is deleted, so readers have until the next one."""
        self.vacuum()
        live, size = self.live(before), self.fan
        while size * self.fan <= before:
            size *= self.fan
        while size >= self.fan:
            windows: dict[int, list[tuple[int, int]]] = {}
            for x in live:
                if x[0] // size == x[1] // size and (x[0] // size + 1) * size <= before:
                    windows.setdefault(x[0] // size, []).append(x)
            for group in (g for g in windows.values() if len(g) > 1):
                whole = (group[0][0], group[-1][1])
                self.merge(self._read(group)).write.mode("overwrite").parquet(self._folder(whole))
                live = [x for x in live if x not in group] + [whole]
            size //= self.fan

    def vacuum(self) -> None:
        keep = set(self.live())
        for x in self.parts():
            if x not in keep:
                fs, p = self._fs(self._folder(x))
                fs.delete(p, True)
