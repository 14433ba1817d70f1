"""A collection's rows on Parquet: a base, and changes since, named by versioned manifests.

    <path>/options.json            distance method, dimensions, bits
    <path>/versions/<n>.json       what version n is made of
    <path>/d-<uuid>/               rows of a base or of a change
    <path>/sketch-<uuid>.json      how its rows' sketches were made

A change writes rows that say what became of each id it names: put, gone, or other
metadata. So it costs what it changes, not what the collection has. Reading takes the
base, without the ids that changed since, and the last of each of these. When changes
have grown to a share of the base, or many, they are written into a new base.

A version is published by creating its manifest, which only one writer can do. Whoever
comes second publishes on top: a change doesn't depend on the rows before it. Nothing is
deleted until ``vacuum``, so readers keep the version they began with.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import lsh
from .sources.files import Files

SCHEMA = "id long, vector array<double>, metadata string"
PUT, GONE, METADATA = 0, 1, 2

#: Changes, and their share of the base's bytes, from which on they are written into a new base. Manifests that are kept.
MOST_CHANGES, CHANGED_SHARE, MANIFESTS = 16, 0.5, 50


def rows_schema() -> T.StructType:
    plain = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("metadata", T.StringType())])
    return T.StructType([*plain.fields, T.StructField("_op", T.IntegerType()), *lsh.COLUMNS.fields])


@dataclass(frozen=True)
class Manifest:
    version: int
    base: str | None = None
    changes: tuple[str, ...] = ()
    sketch: str | None = None


class Store:
    def __init__(self, spark: SparkSession, path: str, method: str, dimensions: int, seed: int = 0) -> None:
        self.spark, self.path, self.method, self.dimensions, self.seed = spark, path, method, dimensions, seed
        self.files = Files(spark, path)

    # --- manifests -----------------------------------------------------------------

    def manifest(self) -> Manifest:
        numbers = [int(m[1]) for n in self.files.names("versions") if (m := re.fullmatch(r"(\d+)\.json", n))]
        if not numbers:
            return Manifest(-1)
        found = json.loads(self.files.read(f"versions/{max(numbers)}.json"))
        return Manifest(found["version"], found["base"], tuple(found["changes"]), found["sketch"])

    def publish(self, manifest: Manifest) -> bool:
        """Whether this version was free; if not, another writer has it."""
        done = self.files.create(f"versions/{manifest.version}.json", json.dumps(asdict(manifest)))
        if done and manifest.version >= MANIFESTS:
            self.files.delete(f"versions/{manifest.version - MANIFESTS}.json")
        return done

    def sketcher(self, manifest: Manifest) -> lsh.Sketcher | None:
        return lsh.Sketcher(**(found := json.loads(self.files.read(manifest.sketch))) | {"centre": tuple(found["centre"])}) if manifest.sketch else None

    def _new_sketcher(self, rows: DataFrame) -> tuple[str, lsh.Sketcher]:
        made = lsh.Sketcher(self.method, self.dimensions, self.seed, lsh.centre_of(rows, self.method, self.dimensions))
        name = f"sketch-{uuid.uuid4().hex}.json"
        self.files.write(name, json.dumps(asdict(made)))
        return name, made

    # --- reading -----------------------------------------------------------------------

    def _read(self, *folders: str) -> DataFrame:
        reader = self.spark.read.schema(rows_schema())
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], rows_schema())

    def rows(self, manifest: Manifest, *extra: str) -> DataFrame:
        """(id, vector, metadata) and sketches of a version; ``extra`` may have "_file"."""
        file = F.col("_metadata.file_path").alias("_file")
        names = [f.name for f in rows_schema() if f.name != "_op"]
        base = self._read(*([manifest.base] if manifest.base else []))
        base = base.select(*names, *([file if manifest.base else F.lit("").alias("_file")] if "_file" in extra else []))
        if not manifest.changes:
            return base
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        at = F.array_position(F.array(*map(F.lit, manifest.changes)), folder)
        rest = [n for n in names if n not in ("id", "metadata")]
        changed = self._read(*manifest.changes).select("id", "_op", "metadata", *rest, file, at.alias("_at"))
        put = F.max(F.when(F.col("_op") != METADATA, F.struct("_at", "_op", "metadata", *rest, "_file"))).alias("_put")
        meta = F.max(F.when(F.col("_op") == METADATA, F.struct("_at", "metadata"))).alias("_meta")
        state = changed.groupBy("id").agg(put, meta).withColumn("_known", F.lit(True))
        out = lambda metadata, column: [F.col("id"), *(metadata.alias("metadata") if n == "metadata" else column(n).alias(n) for n in names[1:]), *(column(e).alias(e) for e in extra)]
        kept = base.join(state.select("id", F.col("_put").isNotNull().alias("_gone"), F.col("_meta"), "_known"), "id", "left")
        kept = kept.where("_known IS NULL OR NOT _gone").select(*out(F.when(F.col("_meta").isNotNull(), F.col("_meta.metadata")).otherwise(F.col("metadata")), F.col))
        later = F.when(F.col("_meta._at") > F.col("_put._at"), F.col("_meta.metadata")).otherwise(F.col("_put.metadata"))
        return kept.unionByName(state.where(F.col("_put._op") == PUT).select(*out(later, lambda n: F.col(f"_put.{n}"))))

    def size(self, manifest: Manifest) -> int:
        return sum(self.files.size(f) for f in (*([manifest.base] if manifest.base else []), *manifest.changes))

    # --- changing -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, sketcher: lsh.Sketcher, spread: bool = False) -> str:
        name = f"d-{uuid.uuid4().hex}"
        rows = sketcher.sketched(rows.select("id", "vector", "metadata", "_op"))
        rows = rows.repartitionByRange("id") if spread else rows
        rows.sortWithinPartitions("id").write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, rows: DataFrame, puts_only: bool = False) -> None:
        """Publish a change: (id, vector, metadata, _op), an id once."""
        name = made_for = None
        while True:
            now = self.manifest()
            sketch, sketcher = now.sketch, self.sketcher(now)
            if sketcher is None:
                sketch, sketcher = self._new_sketcher(rows)
            if name is None or sketch != made_for:
                name, made_for = self._write(rows, sketcher), sketch
            first = puts_only and now.base is None and not now.changes
            after = replace(now, version=now.version + 1, sketch=sketch)
            if self.publish(replace(after, base=name) if first else replace(after, changes=(*now.changes, name))):
                break
        if not first and (len(now.changes) + 1 >= MOST_CHANGES or sum(map(self.files.size, (*now.changes, name))) > CHANGED_SHARE * (self.files.size(now.base) if now.base else 0)):
            self.compact()

    def compact(self, recentre: bool = False) -> None:
        """Write the rows of the current version as a new base, in the order of ids; changes
        that others publish meanwhile stay on top. ``recentre``: with sketches from the mean
        of all vectors, for which nobody may come between; it is tried again then."""
        while True:
            seen = self.manifest()
            rows = self.rows(seen).select("id", "vector", "metadata", F.lit(PUT).alias("_op"))
            sketch, sketcher = (None, None) if recentre else (seen.sketch, self.sketcher(seen))
            if sketcher is None:
                sketch, sketcher = self._new_sketcher(rows)
            base = self._write(rows, sketcher, spread=True)
            while True:
                now = self.manifest()
                ours = now.base == seen.base and now.changes[: len(seen.changes)] == seen.changes and now.sketch == seen.sketch
                if not ours or (sketch != now.sketch and now.version != seen.version):
                    break
                if self.publish(Manifest(now.version + 1, base, now.changes[len(seen.changes) :], sketch)):
                    return
            self.files.delete(base)
            if not recentre:  # another writer has compacted
                return

    def vacuum(self, keep: int = 1) -> None:
        """Delete what none of the last ``keep`` versions is made of. Changes that are being
        written just now would go too."""
        numbers = sorted(int(m[1]) for n in self.files.names("versions") if (m := re.fullmatch(r"(\d+)\.json", n)))
        used: set[str] = set()
        for n in numbers[-keep:]:
            found = json.loads(self.files.read(f"versions/{n}.json"))
            used.update(x for x in (found["base"], found["sketch"], *found["changes"]) if x)
        for n in numbers[:-keep]:
            self.files.delete(f"versions/{n}.json")
        for name in self.files.names():
            if re.match(r"(d|stage|sketch)-", name) and name not in used:
                self.files.delete(name)
