"""Parquet tables in buckets: a change rewrites the buckets it touches and nothing else."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import fresh, q

MANIFEST = "_MANIFEST"
#: Tags of writes that are remembered.
TAGS = 1000


class BucketTable:
    """A table whose rows lie in the bucket of the hash of their keys.

    A manifest names the folders of each bucket. A write makes new folders first and replaces the
    manifest last, by a rename, so a reader sees a whole state and a failed write leaves the old one. One
    writer at a time. ``buckets`` is fixed when the table is first written; the manifest has it, so its
    size and all that the driver sees of a change are bounded by the number of buckets.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.buckets = int(self._manifest().get("buckets", buckets))

    # manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self) -> dict:
        fs, p = self._fs(f"{self.root}/{MANIFEST}")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tags(self) -> list[str]:
        """The tags of the last ``TAGS`` writes that had one."""
        return list(self._manifest().get("tags", []))

    def _commit(self, folders: dict[str, list[str]], schema: str, tag: str | None = None) -> None:
        m = self._manifest()
        n = int(m.get("version", 0)) + 1
        tags = [*m.get("tags", []), *([tag] if tag is not None else [])][-TAGS:]
        body = {"version": n, "buckets": self.buckets, "schema": schema, "folders": folders, "tags": tags}
        fs, p = self._fs(f"{self.root}/{MANIFEST}.{n}")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()
        _, to = self._fs(f"{self.root}/{MANIFEST}")
        fs.delete(to, False)
        fs.rename(p, to)

    @property
    def version(self) -> int:
        return int(self._manifest().get("version", 0))

    # rows

    def bucket_of(self) -> Column:
        """The bucket of a row; all rows without keys share those of their nulls."""
        return F.pmod(F.xxhash64(*[q(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall in; at most ``buckets`` numbers reach the driver."""
        return sorted(r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect())

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets: only their folders are listed and read. None before the
        first write."""
        m = self._manifest()
        if not m:
            return None
        wanted = m["folders"] if buckets is None else {str(b): m["folders"].get(str(b), []) for b in buckets}
        paths = sorted(f"{self.root}/{f}" for fs in wanted.values() for f in fs)
        if not paths:
            return self.spark.createDataFrame([], m["schema"])
        return self.spark.read.schema(m["schema"]).parquet(*paths)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes the rows, a folder for each bucket that has some."""
        name = f"data-{uuid.uuid4().hex}"
        col = fresh(rows, "tm_bucket")
        rows.withColumn(col, self.bucket_of()).write.partitionBy(col).parquet(f"{self.root}/{name}")
        fs, p = self._fs(f"{self.root}/{name}")
        out = {}
        for s in fs.listStatus(p):
            leaf = s.getPath().getName()
            if leaf.startswith(f"{col}="):
                out[int(leaf.split("=")[1])] = f"{name}/{leaf}"
        return out

    def _schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def rewrite(self, buckets: Sequence[int], rows: DataFrame, tag: str | None = None) -> None:
        """``rows`` become all that ``buckets`` hold; the other buckets stay as they are."""
        m = self._manifest()
        folders = dict(m.get("folders", {}))
        made = self._write(rows)
        for b in {*buckets, *made}:
            folders[str(b)] = [made[b]] if b in made else []
        self._commit(folders, self._schema(rows), tag)

    def append(self, rows: DataFrame) -> None:
        """Adds rows; what is stored is not read."""
        m = self._manifest()
        folders = {b: list(f) for b, f in m.get("folders", {}).items()}
        old = self.read([])
        rows = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        for b, f in self._write(rows).items():
            folders.setdefault(str(b), []).append(f)
        self._commit(folders, self._schema(rows))

    def vacuum(self) -> int:
        """Deletes the folders that the manifest no longer names; frames over older states break."""
        named = {f for fs in self._manifest().get("folders", {}).values() for f in fs}
        fs, p = self._fs(self.root)
        gone = 0
        if not fs.exists(p):
            return 0
        for s in fs.listStatus(p):
            if s.getPath().getName().startswith("data-"):
                for leaf in fs.listStatus(s.getPath()):
                    if leaf.isDirectory() and f"{s.getPath().getName()}/{leaf.getPath().getName()}" not in named:
                        gone += bool(fs.delete(leaf.getPath(), True))
        return gone
