"""A table of vectors kept as a base, deltas with tombstones, and numbered manifests that name what is live.

A change is written as a delta of its own folder first; then a manifest with the next number is put in place by
a rename that never replaces a file. Readers take the highest number. A write that fails, or loses the race for its
number, leaves folders that no manifest names and changes nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Manifest:
    """What is live: folders below the store's root, the deltas in the order in which they hold."""

    number: int = 0
    base: str | None = None
    deltas: list[str] = field(default_factory=list)


class ConcurrentChange(RuntimeError):
    """Another writer has put its manifest in place first; read again and repeat."""


class VectorStore:
    """Vectors (an id, and any other columns) by versions, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def live(self) -> Manifest:
        """The manifest with the highest number; an empty store has number 0."""
        fs, folder = self._files(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()]
        if not numbers:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/manifests/{max(numbers):012d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> Manifest:
        fs = self._files()
        draft, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{new.number:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise ConcurrentChange(f"manifest {new.number} is there already")
        return new

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Manifest:
        """One delta: rows that are new or take the place of others, and ids that go. An id that is in both is there.

        Of rows that repeat an id within one change one stays, that with the greatest other columns' hash.
        """
        before = self.live()
        parts = []
        if upserts is not None:
            others = [c for c in upserts.columns if c != self.key]
            one = upserts.groupBy(self.key).agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("r"))
            parts.append(one.select(self.key, F.col("r"), F.lit(False).alias("gone")))
        if deletes is not None:
            gone = deletes.select(self.key).distinct()
            if parts:
                gone = gone.join(parts[0].select(self.key), self.key, "left_anti")
                parts.append(gone.select(self.key, F.lit(None).cast(parts[0].schema["r"].dataType).alias("r"), F.lit(True).alias("gone")))
            else:
                shape = self.read().drop(self.key).schema
                parts.append(gone.select(self.key, F.lit(None).cast(shape).alias("r"), F.lit(True).alias("gone")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._commit(Manifest(before.number + 1, before.base, [*before.deltas, self._write(rows, "delta")]))

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """The live rows, or those of an earlier manifest: of each id its last change, else what the base has.

        Only ids of the deltas are sent to the base's rows; the base itself is neither sorted nor grouped.
        """
        m = manifest or self.live()
        base = self.spark.read.parquet(f"{self.root}/{m.base}") if m.base else None
        if not m.deltas:
            if base is None:
                raise FileNotFoundError(f"{self.root} has no rows yet")
            return base
        changes = [self.spark.read.parquet(f"{self.root}/{d}").withColumn("at", F.lit(i)) for i, d in enumerate(m.deltas)]
        joined = changes[0]
        for c in changes[1:]:
            joined = joined.unionByName(c)
        last = joined.groupBy(self.key).agg(F.max_by(F.struct("r", "gone"), "at").alias("c"))
        fresh = last.where("not c.gone").select(self.key, "c.r.*")
        if base is None:
            return fresh
        return base.join(joined.select(self.key).distinct(), self.key, "left_anti").unionByName(fresh.select(*base.columns))

    def compact(self) -> Manifest:
        """A new base of what is live; changes made meanwhile stay deltas, or the compaction is refused."""
        before = self.live()
        base = self._write(self.read(before), "base")
        return self._commit(Manifest(before.number + 1, base, []))

    def unused(self) -> list[str]:
        """Folders that the live manifest does not name: of failed writes, and of earlier versions."""
        fs, m = self._files(), self.live()
        there = [s.getPath().getName() for s in fs.listStatus(self._path(""))] if fs.exists(self._path("")) else []
        return sorted(n for n in there if n.startswith(("base-", "delta-")) and n != m.base and n not in m.deltas)

    def clean(self) -> list[str]:
        """Delete what is unused; only for times without readers of earlier versions and without writers."""
        gone = self.unused()
        for name in gone:
            self._files().delete(self._path(name), True)
        return gone
