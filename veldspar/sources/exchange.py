"""Export and import of collections as JSON, and loads from CSV."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection, CollectionOptions
from ..functions import vectors
from ..functions.vectors import doubles
from .files import Files

RECORD = "id long, vector array<double>, metadata variant"


def vector_text(v: Column, precision: int | None = 6) -> Column:
    """A vector as JSON text, with so many decimals, or with all there are (None). What is
    rounded is the double itself, and half goes to even, as in C and SQL; format_string
    would round the shortest decimals that denote it, and half up."""
    if precision is None:
        return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: x.cast("string")), ","), F.lit("]"))
    odd = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}

    def shown(x: float | None) -> str:
        text = "null" if x is None else f"{x:.{precision}f}"
        return odd.get(text, text)

    def texts(column: pa.Array) -> pa.Array:
        return pa.array([None if found is None else f"[{','.join(map(shown, found))}]" for found in column.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(doubles(v))


def export_lines(frame: DataFrame, precision: int | None = 6) -> DataFrame:
    """(id, value): each record as a JSON object, in the order of ids. Metadata must be JSON;
    where it isn't, the job fails."""
    meta = F.expr("CASE WHEN metadata IS NULL THEN 'null' ELSE to_json(parse_json(metadata)) END")
    value = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"vector":'), vector_text(F.col("vector"), precision), F.lit(',"metadata":'), meta, F.lit("}"))
    return frame.select("id", value.alias("value")).orderBy("id")


def header(options: CollectionOptions) -> dict:
    return {"name": options.name, "distance_method": vectors.METHODS.index(options.distance_method), "dimension_count": options.dimension_count, "quantization": options.quantization}


def export_json(collection: Collection, out: TextIO, precision: int | None = 6) -> None:
    """One JSON document {"collection": ..., "records": [...]}, streamed partition by partition."""
    out.write(f'{{"collection":{json.dumps(header(collection.options))},"records":[')
    for n, row in enumerate(export_lines(collection.frame(), precision).toLocalIterator()):
        out.write((",\n" if n else "\n") + row.value)
    out.write("\n]}\n")


def export_folder(collection: Collection, path: str, precision: int | None = 6) -> None:
    """The same for any size: a folder with collection.json and records as JSON lines."""
    export_lines(collection.frame(), precision).select("value").write.mode("error").text(f"{path}/records")
    collection.spark.createDataFrame([(json.dumps(header(collection.options)),)], "value string").coalesce(1).write.mode("error").text(f"{path}/collection")


def _options(found: dict, name: str) -> CollectionOptions:
    method = found["distance_method"]
    return CollectionOptions(name, method if isinstance(method, str) else vectors.METHODS[method], found["dimension_count"], found["quantization"])


def _loaded(spark: SparkSession, root: str, options: CollectionOptions, rows: DataFrame, **kwargs) -> Collection:
    made = Collection.open(spark, root, options, "create_and_overwrite", **kwargs)
    made.upsert(rows.select("id", "vector", F.to_json("metadata").alias("metadata")))
    return made


def import_json(spark: SparkSession, root: str, name: str, source: TextIO, **kwargs) -> Collection:
    """A collection from what export_json wrote. "collection" comes before "records", and no
    other key is allowed."""
    pairs = json.load(source, object_pairs_hook=list)
    if not isinstance(pairs, list) or not pairs or not isinstance(pairs[0], tuple):
        raise ValueError("an export is a JSON object")
    keys = [k for k, _ in pairs]
    unknown = [k for k in keys if k not in ("collection", "records")]
    if unknown:
        raise ValueError(f"an export has no key {unknown[0]!r}")
    if "collection" not in keys:
        raise ValueError("the export has no collection")
    if "records" in keys and keys.index("records") < keys.index("collection"):
        raise ValueError("the collection comes before the records")
    found = {k: v for k, v in pairs}
    plain = lambda v: {k: plain(x) for k, x in v} if isinstance(v, list) and v and all(isinstance(x, tuple) for x in v) else [plain(x) for x in v] if isinstance(v, list) else v
    records = [plain(r) for r in found.get("records") or []]
    made = Collection.open(spark, root, _options(dict(found["collection"]), name), "create_and_overwrite", **kwargs)
    if records:
        made.upsert(records)
    return made


def import_file(spark: SparkSession, root: str, name: str, path: str, **kwargs) -> Collection:
    """A collection from a file that export_json wrote, read in parallel: its first line has
    the options, each line between the first and the last a record. A JSON document of any
    other shape goes through import_json, on the driver."""
    head, tail = '{"collection":', ',"records":['
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or not (first.value.startswith(head) and first.value.endswith(tail)):
        files = Files(spark, path)
        return import_json(spark, root, name, io.StringIO(files.read("")), **kwargs)
    found = json.loads(first.value.removeprefix(head).removesuffix(tail))
    rows = lines.where(~F.col("value").startswith(head) & ~F.trim("value").isin("]}", "", ",")).select(F.ltrim("value").alias("value"))
    rows = rows.select(F.from_json(F.regexp_replace("value", ",$", ""), RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return _loaded(spark, root, _options(found, name), rows, **kwargs)


def import_folder(spark: SparkSession, root: str, name: str, path: str, **kwargs) -> Collection:
    """A collection from what export_folder wrote, read in parallel."""
    found = json.loads(spark.read.text(f"{path}/collection").first()[0])
    return _loaded(spark, root, _options(found, name), spark.read.schema(RECORD).json(f"{path}/records"), **kwargs)


def load_csv(collection: Collection, path: str, text_column: int, metadata_columns: dict[str, int] | None = None, header: bool = False, resume: bool = False, multi_line: bool = True) -> int:
    """Rows of a CSV file whose text is embedded; how many were loaded.

    Ids follow on the largest in the collection, in the order of the file; rows without text
    have none. With ``resume`` ids are the numbers of rows, and as many rows are passed over
    as the collection has documents, so that a load that broke off goes on. With
    ``multi_line`` fields may have line breaks, for which a file is read by one task.
    """
    spark = collection.spark
    rows = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = rows.columns
    text = F.col(f"`{names[text_column]}`")
    meta = F.to_json(F.struct(*(F.col(f"`{names[i]}`").alias(n) for n, i in (metadata_columns or {"text": text_column}).items())))
    there = len(collection)
    start = 0 if resume else (collection.frame().agg(F.max("id")).first()[0] + 1 if there else 0)
    # numbers within partitions, which follow one another as the file does, and what comes before each
    numbered = rows.where(text.isNotNull()).select(F.monotonically_increasing_id().alias("_n"), text.alias("text"), meta.alias("metadata"))
    part = F.shiftright("_n", 33)
    counts = sorted((r.p, r.n) for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not counts:
        return 0
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), part)
    number = offset + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    new = numbered.select((number + start).alias("id"), "text", "metadata")
    skipped = min(there, total) if resume else 0
    if total > skipped:
        collection.upsert(new.where(F.col("id") >= skipped) if resume else new)
    return total - skipped


def batches(rows: Iterable, size: int = 100) -> Iterator[list]:
    """Lists of so many rows, for loads from a driver-side iterator."""
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
