"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and never changes. Bytes are summed by slot, and
a map of ``SLOTS`` entries, whose size doesn't depend on the data, says which shard has
a slot. Rebalancing writes a new version of the map with as few slots moved as it takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table_path

SLOTS, SHARDS = 4096, 16
#: Share by which the fullest shard may exceed the mean.
TOLERANCE = 0.02


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the key's MD5, modulo the slots; a null key has slot 0."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(head, F.lit(slots)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    assigned: tuple[int, ...]

    @staticmethod
    def initial(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: while the fullest shard is beyond the tolerance, its largest
        slot of at most half the gap goes to the emptiest one. Of equals, the lowest
        shard and the lowest slot. A changed number of shards adds empty ones, or has
        the slots of those that go moved to the emptiest in turn, largest first."""
        n = shards or self.shards
        assigned, loads = list(self.assigned), [0] * n
        homeless = []
        for slot, shard in enumerate(assigned):
            if shard < n:
                loads[shard] += slot_bytes.get(slot, 0)
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda s: (-slot_bytes.get(s, 0), s)):
            to = loads.index(min(loads))
            assigned[slot] = to
            loads[to] += slot_bytes.get(slot, 0)
        limit = sum(loads) * round((1 + tolerance) * 1000)
        while max(loads) * n * 1000 > limit:
            high, low = loads.index(max(loads)), loads.index(min(loads))
            gap = loads[high] - loads[low]
            fits = [(-slot_bytes.get(s, 0), s) for s, x in enumerate(assigned) if x == high and 0 < 2 * slot_bytes.get(s, 0) <= gap]
            if not fits:
                break
            minus, slot = min(fits)
            assigned[slot] = low
            loads[high] += minus
            loads[low] -= minus
        return SlotMap(self.version + 1, n, tuple(assigned))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, x) for s, x in enumerate(self.assigned)], "map_version int, shards int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version under ``path``; one that is there already is an error."""
        self.frame(spark).drop("map_version").coalesce(1).write.mode("error").parquet(f"{path}/map_version={self.version}")

    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The latest version under ``path``; None where there is none yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        return SlotMap.load(spark, path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, the latest by default."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("map_version")).first()[0]
        found = rows.where(F.col("map_version") == version).orderBy("slot").collect()
        if not found:
            raise KeyError(f"no version {version}")
        return SlotMap(version, found[0].shards, tuple(r.shard for r in found))


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> dict[int, int]:
    """UTF-8 bytes of text by slot; at most ``slots`` entries reach the driver."""
    sizes = docs.select(slot_of(F.col("doc_id"), slots).alias("slot"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))
    return {r.slot: r.bytes for r in sizes.groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()}


def placed(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """docs with slot, shard and map_version; columns of these names are replaced. The
    map goes into the plan as one array, so there is no join and no shuffle."""
    slots = len(slot_map.assigned)
    shard = F.get(F.expr(f"array({','.join(map(str, slot_map.assigned))})"), slot_of(F.col("doc_id"), slots))
    kept = docs.drop("slot", "shard", "map_version")
    return kept.select("*", slot_of(F.col("doc_id"), slots).alias("slot"), shard.alias("shard"), F.lit(slot_map.version).alias("map_version"))


def sharded(docs: DataFrame, shards: int = SHARDS, path: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with slot, shard and map_version, of a map balanced for their bytes.

    Where ``path`` has no map, its version 1 deals slots out in turn. The latest version,
    edited for the bytes that were counted and for ``shards``, is stored as the next one,
    which docs are placed by; so each call on a path goes on from the one before. Without
    ``path`` the map is in a new place in the shared folder. A null text has no bytes, a
    null id slot 0; rows of one id share a slot. Without rows, or without bytes, no slot
    moves.
    """
    spark = docs.sparkSession
    path = path or table_path(spark, "slot_map")
    last = SlotMap.latest(spark, path)
    if last is None:
        last = SlotMap.initial(SLOTS, shards)
        last.save(spark, path)
    now = last.rebalanced(slot_bytes(docs, len(last.assigned)), shards, tolerance)
    now.save(spark, path)
    return placed(docs, now)


#: DuckDB, for sharded(documents) without the text.
SHARDED_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SLOTS}, 0)::INT AS slot
  FROM documents),
slots AS (SELECT list(coalesce(b, 0)::BIGINT ORDER BY s) AS b
          FROM range({SLOTS}) r(s) LEFT JOIN (SELECT slot, sum(bytes) AS b FROM docs GROUP BY slot) d ON d.slot = s),
moves(step, assigned, loads) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda s: (s % {SHARDS})::BIGINT),
         list_transform(range({SHARDS}), lambda x: coalesce(list_sum(list_transform(range({SLOTS}), lambda s: CASE WHEN s % {SHARDS} = x THEN b[s + 1] ELSE 0 END)), 0)::BIGINT)
  FROM slots
  UNION ALL
  SELECT step + 1,
         list_transform(assigned, lambda x, i: CASE WHEN i - 1 = slot THEN low - 1 ELSE x END),
         list_transform(loads, lambda x, i: CASE WHEN i = high THEN x - moved WHEN i = low THEN x + moved ELSE x END)
  FROM (
    SELECT step, assigned, loads, high, low, {SLOTS} - 1 - best % {SLOTS} AS slot, best // {SLOTS} AS moved
    FROM (
      SELECT step, assigned, loads, high, low,
             list_max(list_transform(range({SLOTS}), lambda s:
               CASE WHEN assigned[s + 1] = high - 1 AND b[s + 1] > 0 AND 2 * b[s + 1] <= loads[high] - loads[low]
                    THEN b[s + 1] * {SLOTS} + {SLOTS} - 1 - s END)) AS best
      FROM (SELECT *, list_position(loads, list_max(loads)) AS high, list_position(loads, list_min(loads)) AS low FROM moves
            WHERE list_max(loads) * {SHARDS} * 1000 > list_sum(loads) * {round((1 + TOLERANCE) * 1000)}), slots)
    WHERE best IS NOT NULL)),
final AS (SELECT assigned FROM moves ORDER BY step DESC LIMIT 1)
SELECT doc_id, bytes::BIGINT AS bytes, slot, assigned[slot + 1]::INT AS shard, 2 AS map_version FROM docs, final
"""
