"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target share of the text. What the mixture asks of a document is an
expected number of copies, the same for all of a source: its whole part is certain,
its fraction a probability. Pivotal rounding takes two probabilities at a time and
moves mass from one to the other at random, so that one becomes 0 or 1 and every
document keeps its expectation; in the end at most one fraction of a source is left.

Documents are rounded in leaves, and what a leaf leaves over goes up a reduction tree,
``FAN`` leaves to a node, until each source has one rest, which is drawn alone. So
a source's number of copies is the sum of its expectations, rounded up or down.

Probabilities are whole multiples of 2**-32, so sums are exact, and chance is a hash of
the ids: the result doesn't depend on how rows are partitioned, nor on runs repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values, materialise

ONE = 1 << 32
#: Documents of a leaf, about; nodes of one level that the next one joins.
LEAF, FAN = 20_000, 64
#: Without explicit weights, a source's is its bytes to this power.
ALPHA = 0.8
SEED = 17


def draw(seed: int, *ids: int | None) -> int:
    """A number from 0 to 2**32 - 1, by hash."""
    return xxhash.xxh3_64_intdigest(repr((seed, *ids)).encode()) & (ONE - 1)


def pivot(units: Iterable[tuple[int | None, int]], seed: int) -> tuple[list[tuple[int | None, int]], tuple[int | None, int] | None]:
    """(ids and their results 0 or 1, the id and mass left over) of (id, mass) units
    with masses between 0 and ONE, in the order given."""
    done: list[tuple[int | None, int]] = []
    held: tuple[int | None, int] | None = None
    for unit, mass in units:
        if mass == 0 or mass == ONE:
            done.append((unit, mass // ONE))
            continue
        if held is None:
            held = (unit, mass)
            continue
        other, rest = held
        total, u = rest + mass, draw(seed, other, unit)
        if total < ONE:  # one of them falls to 0
            stays, goes = ((other, total), unit) if u * total < rest * ONE else ((unit, total), other)
            done.append((goes, 0))
            held = stays
        else:  # one of them rises to 1; mass left if any
            left = total - ONE
            rises, keeps = (other, unit) if u * (2 * ONE - total) < (ONE - mass) * ONE else (unit, other)
            done.append((rises, 1))
            if left:
                held = (keeps, left)
            else:
                done.append((keeps, 0))
                held = None
    return done, held


_OUT = "source string, node long, doc_id long, mass long, done boolean"


def _rounder(seed: int):
    def rounded(table: pa.Table) -> pa.Table:
        source, node = table.column("source")[0].as_py(), table.column("node")[0].as_py()
        units = sorted(zip(table.column("doc_id").to_pylist(), table.column("mass").to_pylist()), key=lambda x: (draw(seed, x[0]), x[0] is None, x[0] or 0))
        done, held = pivot(units, seed)
        rows = [(i, m, True) for i, m in done] + ([(*held, False)] if held else [])
        n = len(rows)
        ids, masses, finished = zip(*rows)
        return pa.table([pa.array([source] * n, pa.string()), pa.array([node] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array(masses, pa.int64()), pa.array(finished, pa.bool_())], names=["source", "node", "doc_id", "mass", "done"])

    return rounded


def _last(seed: int):
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masses = column_values(batch, "doc_id", "mass")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(draw(seed + 1, i) < m) for i, m in zip(ids, masses)], pa.int64())], ["source", "doc_id", "mass"])

    return last


def expected_copies(docs: DataFrame, weights: dict[str | None, float] | None = None, total_bytes: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, bytes, share, rate): a source's bytes of text, its target share and the
    expected copies of each of its documents.

    Weights that aren't given are bytes ** alpha, which lifts small sources. Where
    weights are given, a source they don't name has none. Without ``total_bytes`` the
    mixture is the smallest that needs no weighted source cut: the least rate is 1.
    A source without any bytes is left as it is, at rate 1. No rows in, no rows out.

    Sources may be many, as domains are: they stay a table, of which the driver sees two
    sums. Weights are added up as decimals, so that their order doesn't matter.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col("source").cast("string").alias("source"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes")).groupBy("source").agg(F.sum("bytes").alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(alpha))).otherwise(F.lit(0.0)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_s string, _w double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "bytes", F.coalesce("_w", F.lit(0.0)).alias("weight"))
    weighed = materialise(weighed, "sources")
    counts = F.col("bytes") > 0
    whole = float(weighed.where(counts).agg(F.coalesce(F.sum(F.col("weight").cast("decimal(28,9)")), F.lit(0))).first()[0])
    share = F.when(counts, F.col("weight") / whole).otherwise(F.lit(0.0)) if whole else F.lit(0.0)
    shared = weighed.select("source", "bytes", share.alias("share"))
    total = total_bytes
    if total is None:
        least = shared.where("share > 0").agg(F.min(F.col("share") / F.col("bytes"))).first()[0]
        total = 1 / least if least else 0.0
    return shared.withColumn("rate", F.when(F.col("bytes") > 0, F.lit(float(total)) * F.col("share") / F.col("bytes")).otherwise(F.lit(1.0)))


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, total_bytes: float | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(source, doc_id, copies) for each document: how often the mixture has it.

    Rows of one source that share a doc_id, null ids too, are one document. A null
    source is a source. No rows in, no rows out. Columns other than doc_id, source and
    text aren't looked at.
    """
    rates = expected_copies(docs, weights, total_bytes, alpha).select(F.col("source").alias("_s"), F.floor(F.col("rate") * ONE + 0.5).cast("long").alias("_mass"))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    units = materialise(rows.join(rates, F.col("source").eqNullSafe(F.col("_s"))).select("source", "doc_id", F.shiftright("_mass", 32).alias("whole"), F.col("_mass").bitwiseAND(F.lit(ONE - 1)).alias("mass")), "units")
    leaves = max(1, -(-units.count() // LEAF))
    level = units.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).alias("node"), "doc_id", "mass")
    finished = []
    while True:
        done = materialise(level.groupBy("source", "node").applyInArrow(_rounder(seed), _OUT), "rounded")
        finished.append(done.where("done").select("source", "doc_id", "mass"))
        level = done.where("NOT done").select("source", F.floor(F.col("node") / FAN).alias("node"), "doc_id", "mass")
        if leaves == 1:
            break
        leaves = -(-leaves // FAN)
    finished.append(level.select("source", "doc_id", "mass").mapInArrow(_last(seed), "source string, doc_id long, mass long"))
    extra = finished[0]
    for part in finished[1:]:
        extra = extra.unionByName(part)
    both = units.select("source", "doc_id", F.col("whole").alias("n")).unionByName(extra.select("source", "doc_id", F.col("mass").alias("n")))
    return both.groupBy("source", "doc_id").agg(F.sum("n").cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, total_bytes: float | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The mixture: each row of docs as often as its document has copies; columns stay. Rows
    without source or doc_id count like others, repeated rows come as often each; an empty
    table stays empty."""
    chosen = materialise(copies(docs, weights, total_bytes, alpha, seed).where("copies > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("copies").alias("_n")), "copies")
    same = docs["doc_id"].cast("long").eqNullSafe(chosen["_d"]) & docs["source"].cast("string").eqNullSafe(chosen["_s"])
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    # the narrow side is built and texts pass by it unsorted, at any size alike
    return docs.join(chosen.hint("shuffle_hash"), same).select(row, F.explode(F.sequence(F.lit(1), chosen["_n"]))).select("row.*")
