"""Several tables with one version: buckets of rows in folders that never change, and a manifest that names the folders of a version.

A commit writes new folders for the buckets that it replaces, then one manifest. Readers go by a manifest, so they see all tables of the old
version or all of the new one; what a failed commit has left is named by none. Two commits on one version collide on the manifest's
number, and the later one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table; a commit rewrites those that hold a touched key.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit has made a version of the same number."""


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> list[Column]:
    """Equality of keys in which nulls are equal."""
    return [a[k].eqNullSafe(b[k]) for k in key]


@dataclass
class Written:
    """Buckets of a table that no version names yet; commit() takes them in place of rows."""

    schema: StructType
    parts: dict[str, str]


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def _manifest(self, n: int) -> dict | None:
        fs, p = self._at(f"{self.path}/_versions/{n:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # its writer was lost: this version never came to be
            return None
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        fs, p = self._at(f"{self.path}/_versions")
        return sorted(int(x.getPath().getName()[:10]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read, the newest last."""
        return [n for n in self._numbers() if self._manifest(n)]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the newest one; version 0 has no tables."""
        numbers = self._numbers() if version is None else [version] if version else []
        for n in reversed(numbers):
            if found := self._manifest(n):
                return found
        return {"version": 0, "batches": {}, "tables": {}}

    def read(self, name: str, schema: StructType | str | None = None, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """A table of a version, or only some of its buckets; a table that isn't there is empty, of *schema*."""
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            return self.spark.createDataFrame([], schema)
        parts = table["parts"] if only is None else {str(b): table["parts"][str(b)] for b in only if str(b) in table["parts"]}
        return self._rows(StructType.fromJson(table["schema"]), parts)

    def _rows(self, kind: StructType, parts: dict[str, str]) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*[f"{folder}/bucket={b}" for b, folder in parts.items()]) if parts else self.spark.createDataFrame([], kind)

    def bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: list[str]) -> list[int]:
        """The buckets that hold these keys; at most as many as a table has."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect())

    def write(self, name: str, rows: DataFrame, key: list[str]) -> Written:
        """The rows in a new folder of the table, to be read by read_written() and published by commit()."""
        folder = f"{self.path}/{name}/{uuid.uuid4().hex[:16]}"
        dealt = rows.withColumn("bucket", self.bucket(key))
        # a bucket's rows may go to several files, so that a key with very many rows is no one's task
        dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy("bucket").parquet(folder)
        fs, p = self._at(folder)
        return Written(rows.schema, {x.getPath().getName().removeprefix("bucket="): folder for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")})

    def read_written(self, written: Written) -> DataFrame:
        return self._rows(written.schema, written.parts)

    def commit(self, tables: dict[str, tuple[DataFrame | Written, list[str]]], only: Iterable[int] | None = None, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publish new contents of *tables* (rows, key), of the buckets in *only* or all of them, and return the version.

        *base* is the version that the rows were made from (the newest where it isn't given); if there is a later one by now, nothing
        is published. batch (stream, number): a batch that has been published before isn't published again.
        """
        before = self.manifest(base)
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        after = {"version": before["version"] + 1, "batches": dict(before["batches"]), "tables": dict(before["tables"])}
        if batch:
            after["batches"][batch[0]] = batch[1]
        for name, (rows, key) in tables.items():
            new = rows if isinstance(rows, Written) else self.write(name, rows, key)
            old = before["tables"].get(name, {}).get("parts", {})
            gone = {str(b) for b in (range(self.buckets) if only is None else only)}
            after["tables"][name] = {"schema": json.loads(new.schema.json()), "parts": {b: f for b, f in old.items() if b not in gone} | new.parts}
        return self._publish(after)

    def _publish(self, manifest: dict) -> int:
        newest = max([0, *self._numbers()])
        if newest > manifest["version"] - 1 and self._manifest(newest):
            raise Conflict(f"version {newest} was published meanwhile")
        number = manifest["version"] = newest + 1  # the number of a writer that was lost isn't used again
        fs, p = self._at(f"{self.path}/_versions/{number:010d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {number} is being published") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Delete the manifests and folders that the last *keep* versions don't name."""
        kept = self.versions()[-keep:]
        named = {f for n in kept for t in self._manifest(n)["tables"].values() for f in t["parts"].values()}
        for n in self._numbers():
            if kept and n < kept[0]:
                fs, p = self._at(f"{self.path}/_versions/{n:010d}.json")
                fs.delete(p, False)
        fs, p = self._at(self.path)
        for table in fs.listStatus(p):
            if table.getPath().getName() != "_versions":
                for x in fs.listStatus(table.getPath()):
                    if not any(f.endswith(f"/{table.getPath().getName()}/{x.getPath().getName()}") for f in named):
                        fs.delete(x.getPath(), True)
