"""A collection: documents (id, vector, metadata) under fixed options, on Parquet.

How rows are stored and changed is in ``storage``: a change is written by itself and
published as a new version, so readers never see a part of it, a failed change leaves
things as they were, and of several writers none loses what it wrote.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import Embedder, HashingEmbedder, QueryEmbedder, embedded
from .filters import VariantSource, bind, compile_filter, parse
from .functions import quantization, vectors
from .operators import lsh, records, search
from .sources.files import Files
from .storage import GONE, METADATA, PUT, SCHEMA, Store

MODES = ("create_if_not_exists", "read_write", "read_only", "create_and_overwrite")


@dataclass(frozen=True)
class CollectionOptions:
    name: str
    distance_method: str = "euclidean"
    dimension_count: int = 0
    quantization: int = 64

    def __post_init__(self) -> None:
        if not self.name or "/" in self.name:
            raise ValueError("a collection's name is a single path segment")
        if self.distance_method not in vectors.METHODS:
            raise ValueError(f"no distance method {self.distance_method!r}")
        if self.dimension_count < 1:
            raise ValueError("vectors have one dimension at least")
        object.__setattr__(self, "quantization", self.quantization or 64)
        quantization.check_bits(self.quantization)


@dataclass
class SearchResults:
    """Rows (id, metadata, distance), lazily, and what was searched for them."""

    rows: DataFrame
    _percent: Callable[[], float]
    embedding_time: float = 0.0
    _cached: float | None = field(default=None, repr=False)

    @property
    def percent_searched(self) -> float:
        if self._cached is None:
            self._cached = self._percent()
        return self._cached

    def collect(self) -> list:
        return self.rows.collect()

    def response(self) -> dict:
        """What the service returns: metadata decoded, rows left out whose metadata is
        neither an object nor null; times in milliseconds."""
        start = time.monotonic()
        shaped = self.rows.withColumn("_v", F.expr("try_parse_json(metadata)")).where("schema_of_variant(_v) LIKE 'OBJECT%' OR schema_of_variant(_v) = 'VOID'")
        found = [{"id": r.id, "metadata": json.loads(r.metadata), "distance": r.distance} for r in shaped.drop("_v").collect()]
        return {"results": found, "percent_searched": self.percent_searched, "search_time": int((time.monotonic() - start) * 1000), "embedding_time": int(self.embedding_time * 1000)}


def _records_frame(spark: SparkSession, rows: Iterable) -> DataFrame:
    data = []
    for n, r in enumerate(rows):
        r = r if isinstance(r, dict) else {"id": r[0], "vector": r[1], "metadata": r[2] if len(r) > 2 else None}
        meta = r.get("metadata")
        data.append((r["id"], [float(x) for x in r["vector"]] if r.get("vector") else None, r.get("text"), meta if meta is None or isinstance(meta, str) else json.dumps(meta), n))
    return spark.createDataFrame(data, "id long, vector array<double>, text string, metadata string, _seq long")


class Collection:
    def __init__(self, spark: SparkSession, root: str, options: CollectionOptions, read_only: bool = False, embedder: Embedder | None = None, default_precision: str = "exact", reference_quirks: bool = False, seed: int = 0) -> None:
        self.spark, self.options, self.read_only = spark, options, read_only
        self.path = f"{root.rstrip('/')}/{options.name}"
        self.store = Store(spark, self.path, options.distance_method, options.dimension_count, seed)
        self.files = self.store.files
        self.embedder = embedder or HashingEmbedder(options.dimension_count)
        self._embed_query = QueryEmbedder(self.embedder)
        self.default_precision, self.reference_quirks = default_precision, reference_quirks

    # --- opening ---------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: CollectionOptions | str, mode: str = "create_if_not_exists", **kwargs) -> Collection:
        """Open or create. The options of a collection that is there already are those it
        was made with, whatever is passed; a name alone opens one that must exist."""
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}")
        name = options if isinstance(options, str) else options.name
        files = Files(spark, f"{root.rstrip('/')}/{name}")
        there = files.exists("options.json")
        if mode == "create_and_overwrite" and there:
            files.delete()
            there = False
        if there:
            options = CollectionOptions(**json.loads(files.read("options.json")))
        elif isinstance(options, str) or mode in ("read_write", "read_only"):
            raise KeyError(f"no collection {name!r}")
        if not there and not files.create("options.json", json.dumps(asdict(options))):
            options = CollectionOptions(**json.loads(files.read("options.json")))  # another has just made it
        return cls(spark, root, options, mode == "read_only", **kwargs)

    # --- reading ---------------------------------------------------------------------

    @property
    def version(self) -> int:
        return self.store.manifest().version

    def frame(self) -> DataFrame:
        """(id, vector, metadata) as they are now. Vectors are what their bits keep of them."""
        return self.store.rows(self.store.manifest()).select("id", "vector", "metadata")

    def __len__(self) -> int:
        return self.frame().count()

    def create_view(self, name: str) -> None:
        """Make the records a temporary view for SQL."""
        self.frame().createOrReplaceTempView(name)

    def ids(self) -> DataFrame:
        return self.frame().select("id").orderBy("id")

    def get(self, doc_id: int):
        rows = self.frame().where(F.col("id") == doc_id).take(1)
        if not rows:
            raise KeyError(doc_id)
        return rows[0]

    def stored_files(self) -> DataFrame:
        """(file, bytes, records): where the records of the current version are."""
        now = self.store.manifest()
        folders = [f"{self.path}/{f}" for f in (*([now.base] if now.base else []), *now.changes)]
        records = self.store.rows(now, "_file").groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("records"))
        if not folders:
            return records.select("file", F.lit(0).cast("long").alias("bytes"), "records")
        meta = F.col("_metadata")
        sizes = self.spark.read.parquet(*folders).select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes")).distinct()
        return sizes.join(records, "file", "left").select("file", "bytes", F.coalesce("records", F.lit(0)).alias("records"))

    def stats(self, sample_pairs: int = 100, seed: int = 0) -> DataFrame:
        frame, o = self.frame(), self.options
        row = (o.name, frame.count(), o.dimension_count, o.quantization, o.distance_method, self.store.size(self.store.manifest()), records.sampled_pair_distance(frame, o.distance_method, sample_pairs, seed))
        return self.spark.createDataFrame([row], "name string, document_count long, dimension_count int, quantization int, distance_method string, storage_size long, average_distance double")

    # --- changing --------------------------------------------------------------------

    def _commit(self, rows: DataFrame, puts_only: bool = False) -> None:
        self._writable()
        self.store.commit(rows, puts_only)

    def upsert(self, rows: DataFrame | Iterable) -> None:
        """Insert or replace by id. A frame has id, metadata, and vector or text or both (a
        vector wins); so have dicts and tuples. Of an id twice in one call the last counts
        (in a frame: the highest ``_seq``, if it has that column). Nothing is written
        unless all rows are valid."""
        new = rows if isinstance(rows, DataFrame) else _records_frame(self.spark, rows)
        d = self.options.dimension_count
        for name, kind in (("vector", "array<double>"), ("text", "string"), ("metadata", "string")):
            if name not in new.columns:
                new = new.withColumn(name, F.lit(None).cast(kind))
        if "_seq" not in new.columns:
            new = new.withColumn("_seq", F.monotonically_increasing_id())
        vector = vectors.doubles("vector")
        given = F.when(F.size(vector) > 0, vector)
        if "text" in (rows.columns if isinstance(rows, DataFrame) else ["text"]):
            given = F.coalesce(given, F.when(F.col("text").isNotNull(), embedded(F.col("text"), self.embedder)))
        new = new.select(F.col("id").cast("long").alias("id"), given.alias("vector"), "metadata", "_seq")
        problem = (
            F.when(F.col("id").isNull() | (F.col("id") < 0), F.lit("an id from 0 to 2**63 - 1"))
            .when(F.col("vector").isNull(), F.lit("a vector or a text"))
            .when(F.size("vector") != d, F.lit(f"a vector of {d} dimensions"))
        )
        self._writable()
        stage = f"stage-{uuid.uuid4().hex}"  # texts are embedded, and rows numbered, once
        try:
            new.withColumn("_problem", problem).write.parquet(f"{self.path}/{stage}")
            staged = self.spark.read.parquet(f"{self.path}/{stage}")
            first = staged.select("id", "_problem").orderBy(F.col("_problem").isNull()).take(1)
            if not first:
                return
            if first[0]._problem is not None:
                raise ValueError(f"record {first[0].id} needs {first[0]._problem}")
            put = records.latest(staged).select("id", quantization.stored(F.col("vector"), self.options.quantization).alias("vector"), "metadata", F.lit(PUT).alias("_op"))
            self._commit(put, puts_only=True)
        finally:
            self.files.delete(stage)

    def update_metadata(self, doc_id: int, metadata: dict | str) -> None:
        """Replace a document's metadata, all of it; KeyError if there is no such document."""
        self.get(doc_id)
        text = metadata if isinstance(metadata, str) else json.dumps(metadata)
        self.update_metadata_batch(self.spark.createDataFrame([(doc_id, text)], "id long, metadata string"))

    def _named(self, ids: DataFrame, op: int, metadata: str | None = None) -> DataFrame:
        meta = F.col(metadata).cast("string") if metadata else F.lit(None).cast("string")
        return ids.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), meta.alias("metadata"), F.lit(op).alias("_op")).where("id IS NOT NULL")

    def update_metadata_batch(self, updates: DataFrame) -> None:
        """(id, metadata) rows; ids that aren't there are passed over. Of an id twice the
        metadata that sorts last counts, null first."""
        last = updates.groupBy("id").agg(F.max("metadata").alias("metadata"))
        self._commit(self._named(last, METADATA, "metadata"))

    def remove_document(self, doc_id: int) -> None:
        self.get(doc_id)
        self.remove([doc_id])

    def remove(self, ids: DataFrame | Iterable[int]) -> None:
        """Remove all of these ids that are there."""
        frame = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id long")
        self._commit(self._named(frame.select("id").distinct(), GONE))

    def compact(self) -> None:
        """Write base and changes as one, which happens by itself once changes have grown."""
        self._writable()
        self.store.compact()

    def vacuum(self, keep: int = 1) -> None:
        """Delete the files that none of the last ``keep`` versions has; results that are still
        to be read from older ones fail then."""
        self._writable()
        self.store.vacuum(keep)

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.options.name} is open for reading only")

    def close(self) -> None:
        """Nothing is held open."""

    # --- searching -------------------------------------------------------------------

    def filtered(self, frame: DataFrame, filter: str | Column | Callable | None, params: dict | None = None) -> tuple[DataFrame, Column | None]:
        """The frame, with parsed metadata where a filter needs it, and its predicate."""
        if filter is None:
            return frame, None
        if isinstance(filter, Column):
            return frame, filter
        if isinstance(filter, str):
            node = bind(parse(filter, self.reference_quirks), params or {})
            return frame.withColumn("_m", F.expr("try_parse_json(metadata)")), compile_filter(node, VariantSource(F.col("_m")), self.reference_quirks)

        def passes(ids: pd.Series, metadata: pd.Series) -> pd.Series:
            return pd.Series([bool(filter(int(i), None if pd.isna(m) else m)) for i, m in zip(ids, metadata)], dtype=bool)

        return frame, F.pandas_udf(passes, "boolean")(F.col("id"), F.col("metadata"))

    def search(
        self,
        vector: Iterable[float] | None = None,
        text: str | None = None,
        k: int = 0,
        radius: float = 0.0,
        limit: int = 0,
        offset: int = 0,
        precision: str | None = None,
        filter: str | Column | Callable | None = None,
        order: str = "string",
        params: dict | None = None,
    ) -> SearchResults:
        """Records, in one of four ways.

        * Neither k nor radius: a page of them (offset, limit; distance 0), by id.
        * k: the k nearest to vector, or to text, which wins over it.
        * radius: all up to that distance; k is then ignored.
        * Either with a precision other than "exact": approximate. Only records whose sketches
          say that they could be near enough are measured; one that is near enough is missed
          by less than one chance in twenty. There are as many rows as in an exact search for
          k, which is what k beyond 1000 gets.

        The filter, a text of the filter language, a Column or a function of (id,
        metadata), comes before distances. ``params`` are values for its :names; those that
        it doesn't give are looked up in the record. Offset and limit count for pages only. A
        negative k or radius alone finds nothing.
        """
        start, now = time.monotonic(), self.store.manifest()
        stored = self.store.rows(now)
        frame = stored.select("id", "vector", "metadata")
        rows, predicate = self.filtered(frame, filter, params)
        if k == 0 and radius == 0:
            page = search.listed(rows, predicate, offset, limit, order)

            def listed_percent() -> float:
                total, matched = frame.count(), (rows if predicate is None else rows.where(predicate)).count()
                return (min(matched, offset + limit) if limit else matched) / total * 100 if total else 0.0

            return SearchResults(page, listed_percent)
        if text is not None:
            vector = self._embed_query(text)
        took = time.monotonic() - start if text is not None else 0.0
        query = [float(x) for x in vector or ()]
        if len(query) != self.options.dimension_count:
            raise ValueError(f"the query needs {self.options.dimension_count} dimensions")
        if (k <= 0 and radius <= 0) or (radius <= 0 and k < 0):
            return SearchResults(self.spark.createDataFrame([], "id long, metadata string, distance double"), lambda: 0.0, took)
        method, q = self.options.distance_method, vectors.literal(query)
        exact = SearchResults(search.within(rows, q, radius, method, predicate) if radius > 0 else search.nearest(rows, q, k, method, predicate), lambda: 100.0 if frame.count() else 0.0, took)
        if (precision or self.default_precision) == "exact":
            return exact
        sketcher = self.store.sketcher(now)
        if sketcher is None or (radius <= 0 and k > lsh.MOST_K):
            return exact
        chosen, predicate = self.filtered(stored, filter, params)
        if radius > 0:
            near = sketcher.candidate(query, radius)
            found = search.within(chosen.where(near), q, radius, method, predicate)
        else:
            found, limit, first = lsh.nearest(chosen, query, k, sketcher, predicate)
            near = sketcher.candidate(query, limit) | F.col("id").isin(first)

        def percent() -> float:
            total, measured = stored.agg(F.count(F.lit(1)), F.count_if(near)).first()
            return measured / total * 100 if total else 0.0

        return SearchResults(found, percent, took)

    def has_index(self) -> bool:
        """Whether records have sketches: as soon as there were any."""
        return self.store.manifest().sketch is not None

    def build_index(self) -> None:
        """Make all sketches anew, from the mean of the vectors as they are now. Changes bring
        their own sketches, so this is for collections whose vectors have become others."""
        self._writable()
        if self.has_index():
            self.store.compact(recentre=True)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) for each of many queries (query_id, vector)."""
        return search.nearest_batch(self.frame(), queries, k, self.options.distance_method)

    def search_batch_approximate(self, queries: DataFrame, k: int) -> DataFrame:
        """The same through sketches, with a column ``searched``: how many records were measured."""
        now = self.store.manifest()
        return lsh.nearest_batch(self.store.rows(now), queries, k, self.store.sketcher(now) or lsh.Sketcher(self.options.distance_method, self.options.dimension_count))
