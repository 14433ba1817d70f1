"""Queries of the engine by name, and their SQL for DuckDB.

Each runs over its whole table. Limits are there only as the k or the page of a search.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import service
from ..collection import MODES, Collection, CollectionOptions
from ..embed import LetterEmbedder, QueryEmbedder, embedded
from ..engine import Engine
from ..filters import NativeSource, VariantSource, bind, compile_filter, parse
from ..functions import quantization, vectors
from ..operators import records, search
from ..sources import exchange, spans
from ..sources.exchange import vector_text
from ..sources.files import table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return keep


# --- collections made of the driver's tables -------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, metadata, label)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.doubles("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"), "label")


def query_vector(spark: SparkSession, sf_dir: str, doc_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == doc_id).select(vectors.doubles("embedding")).first()[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, m): m is a VARIANT of lang, source, n_chars, tags, stats and, for labelled
    documents alone, quality and toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    meta = F.to_json(
        F.struct(
            "lang", "source", "n_chars", "quality", "toxic",
            F.array("lang", "source").alias("tags"),
            F.struct(F.col("n_chars").alias("chars"), F.struct(F.col("source").alias("name")).alias("origin")).alias("stats"),
            F.array(F.struct((F.col("n_chars") % 7).alias("n")), F.struct((F.col("n_chars") % 5).alias("n"))).alias("items"),
        )
    )
    return docs.drop("text").join(labels, "doc_id", "left").select("doc_id", F.parse_json(meta).alias("m"))


DOCS_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def passing(frame: DataFrame, text: str, **kwargs) -> DataFrame:
    return frame.where(compile_filter(parse(text, extended=True), VariantSource(F.col("m")), **kwargs))


def six(column: Column) -> Column:
    return F.round(column, 6)


def shown(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("id", six(F.col("distance")).alias("distance"), *extra)


E = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
EQ = f"(SELECT e.*, q.v AS q FROM {E} e, (SELECT v FROM {E} WHERE id = 0) q)"
DISTANCE = {
    "euclidean": "list_distance(v, q)",
    "cosine": "acos(greatest(-1, least(1, list_cosine_similarity(v, q)))) / pi()",
}
RADIUS = {"euclidean": 1.3, "cosine": 0.45}


#: Collections of the driver's tables, made once for each session and folder.
_STORED: dict[tuple, Collection] = {}


def stored(spark: SparkSession, sf_dir: str, method: str, bits: int = 64, changed: str | None = None) -> Collection:
    """The embeddings as a collection in the shared folder. ``changed``: SQL for other metadata."""
    key = (spark.sparkContext.applicationId, sf_dir, method, bits, changed)
    if key not in _STORED:
        _STORED[key] = fresh(spark, sf_dir, method, bits, changed)
    return _STORED[key]


def fresh(spark: SparkSession, sf_dir: str, method: str, bits: int = 64, changed: str | None = None) -> Collection:
    engine = Engine(spark, table_path(spark, "engine"))
    made = engine.create_collection("embeddings", len(query_vector(spark, sf_dir)), bits, method)
    rows = embeddings(spark, sf_dir)
    made.upsert((rows.withColumn("metadata", F.expr(changed)) if changed else rows).drop("label"))
    return made


# --- search --------------------------------------------------------------------------


def held_to_exact(kept: Collection, k: int = 10) -> DataFrame:
    """(queries, filled, recalled, saved): approximate batch search of the collection's vectors whose
    id 20 divides against the exact one."""
    queries = kept.frame().where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    near, true = kept.search_batch_approximate(queries, k), kept.search_batch(queries, k).select("query_id", "id", F.lit(1).alias("hit"))
    by_query = near.join(true, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.max("searched").alias("searched"))
    total = len(kept)
    return by_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.bool_and(F.col("n") == min(k, total)).alias("filled"),
        (F.sum("hits") >= 0.9 * F.sum("n")).alias("recalled"),
        (F.avg("searched") <= 0.5 * total).alias("saved"),
    )


def _search_queries(method: str) -> None:
    d = f"SELECT id, round({DISTANCE[method]}, 6) AS distance FROM {EQ}"
    r = RADIUS[method]

    @register(f"knn_{method}", f"{d} ORDER BY {DISTANCE[method]}, id LIMIT 10")
    def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(search.nearest(embeddings(spark, sf_dir), vectors.literal(query_vector(spark, sf_dir)), 10, method))

    @register(f"radius_{method}", f"{d} WHERE {DISTANCE[method]} <= {r}")
    def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(search.within(embeddings(spark, sf_dir), vectors.literal(query_vector(spark, sf_dir)), r, method))

    @register(f"knn_filtered_{method}", f"{d} WHERE label IN (1, 3, 5) ORDER BY {DISTANCE[method]}, id LIMIT 10")
    def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = embeddings(spark, sf_dir)
        predicate = compile_filter(parse("label IN [1, 3, 5]"), NativeSource(frame.schema))
        return shown(search.nearest(frame, vectors.literal(query_vector(spark, sf_dir)), 10, method, predicate))

    @register(f"radius_filtered_{method}", f"{d} WHERE label >= 4 AND {DISTANCE[method]} <= {r}")
    def radius_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = embeddings(spark, sf_dir).withColumn("m", F.parse_json("metadata"))
        predicate = compile_filter(parse("label >= 4"), VariantSource(F.col("m")))
        return shown(search.within(frame, vectors.literal(query_vector(spark, sf_dir)), r, method, predicate))

    @register(f"knn_lsh_{method}")
    def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(stored(spark, sf_dir, method).search(query_vector(spark, sf_dir), k=10, precision="medium").rows)

    @register(f"radius_lsh_{method}")
    def radius_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(stored(spark, sf_dir, method).search(query_vector(spark, sf_dir), radius=r, precision="medium").rows)

    @register(f"lsh_recall_{method}", f"SELECT count(*) AS queries, true AS filled, true AS recalled, true AS saved FROM {E} WHERE id % 20 = 0")
    def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Approximate against exact search, for every vector whose id 20 divides: whether there
        are ten rows for each query, nine in ten of the true ones, and half measured at most."""
        return held_to_exact(stored(spark, sf_dir, method))

    @register(f"lsh_after_changes_{method}", f"SELECT count(*) AS queries, true AS filled, true AS recalled, true AS saved FROM {E}, (VALUES (0), (1000000)) t(x) WHERE label <> 7 AND (label = 3 OR x = 0) AND (id + x) % 20 = 0")
    def after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same once records were put in, replaced and removed, which keep their sketches up."""
        kept, frame = fresh(spark, sf_dir, method), embeddings(spark, sf_dir)
        kept.upsert(_updates(frame))
        kept.remove(frame.where("label = 7").select("id"))
        return held_to_exact(kept)

    @register(f"avg_pairwise_distance_{method}", f"SELECT round(avg({DISTANCE[method]}), 6) AS average_distance FROM (SELECT a.v, b.v AS q FROM {E} a JOIN {E} b ON a.id < b.id)")
    def average(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records.mean_pair_distance(embeddings(spark, sf_dir), method).select(six(F.col("average_distance")).alias("average_distance"))

    @register(
        f"knn_batch_{method}",
        f"""SELECT query_id, id, distance, rank FROM (
              SELECT b.id AS query_id, a.id, round({DISTANCE[method]}, 6) AS distance,
                     row_number() OVER (PARTITION BY b.id ORDER BY {DISTANCE[method]}, a.id)::INT AS rank
              FROM (SELECT a.id AS aid, b.id AS bid, a.v, b.v AS q FROM {E} a, {E} b WHERE b.id % 20 = 0) p
              JOIN {E} a ON a.id = aid JOIN {E} b ON b.id = bid) WHERE rank <= 5""".replace("list_distance(v, q)", "list_distance(p.v, p.q)").replace("similarity(v, q)", "similarity(p.v, p.q)"),
    )
    def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = embeddings(spark, sf_dir)
        queries = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
        found = search.nearest_batch(frame, queries, 5, method)
        return found.select("query_id", "id", six(F.col("distance")).alias("distance"), "rank")

    @register(
        f"knn_batch_all_{method}",
        f"""SELECT query_id, id, round(d, 6) AS distance, rank FROM (
              SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS rank
              FROM (SELECT b_id AS query_id, id, {DISTANCE[method]} AS d FROM (SELECT a.id, a.v, b.id AS b_id, b.v AS q FROM {E} a, {E} b))) WHERE rank <= 5""",
    )
    def batch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = embeddings(spark, sf_dir)
        found = search.nearest_batch(frame, frame.select(F.col("id").alias("query_id"), "vector"), 5, method)
        return found.select("query_id", "id", six(F.col("distance")).alias("distance"), "rank")


for _method in vectors.METHODS:
    _search_queries(_method)


@register("radius_overrides_k", f"SELECT id, round({DISTANCE['euclidean']}, 6) AS distance FROM {EQ} WHERE {DISTANCE['euclidean']} <= 1.3")
def radius_overrides_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stored(spark, sf_dir, "euclidean").search(query_vector(spark, sf_dir), k=3, radius=1.3).rows)


@register("list_page", f"SELECT id, 0.0::DOUBLE AS distance FROM {E} ORDER BY id::VARCHAR LIMIT 20 OFFSET 40")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listed(embeddings(spark, sf_dir), None, 40, 20).select("id", "distance")


@register("list_page_numeric", f"SELECT id, 0.0::DOUBLE AS distance FROM {E} ORDER BY id LIMIT 20 OFFSET 40")
def list_page_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listed(embeddings(spark, sf_dir), None, 40, 20, "numeric").select("id", "distance")


@register("list_all", f"SELECT id, '{{\"label\":' || label || '}}' AS metadata, 0.0::DOUBLE AS distance FROM {E}")
def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listed(embeddings(spark, sf_dir))


@register("list_filtered_page", f"SELECT id, 0.0::DOUBLE AS distance FROM {E} WHERE label = 2 ORDER BY id::VARCHAR LIMIT 10 OFFSET 5")
def list_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = embeddings(spark, sf_dir)
    return search.listed(frame, compile_filter(parse("label == 2"), NativeSource(frame.schema)), 5, 10).select("id", "distance")


@register("host_predicate", f"SELECT id, 0.0::DOUBLE AS distance FROM {E} WHERE label = 7")
def host_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "cosine").search(filter=lambda i, m: json.loads(m)["label"] == 7).rows.select("id", "distance")


@register("point_lookup", f"SELECT id, label FROM {E} WHERE id = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir, "cosine").get(7)
    return spark.createDataFrame([(found.id, json.loads(found.metadata)["label"])], f"id long, label {embeddings(spark, sf_dir).schema['label'].dataType.simpleString()}")


@register("percent_searched", f"""SELECT 100.0::DOUBLE AS exact, 100.0::DOUBLE AS list, round(60 * 100.0 / count(*), 6)::DOUBLE AS page,
    round(count(*) FILTER (label >= 4) * 100.0 / count(*), 6)::DOUBLE AS filtered, true AS approximate FROM {E}""")
def percent_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, q = stored(spark, sf_dir, "cosine"), query_vector(spark, sf_dir)
    searches = ({"vector": q, "k": 3}, {}, {"limit": 20, "offset": 40}, {"filter": "label >= 4"})
    shares = [round(kept.search(**s).percent_searched, 6) for s in searches]
    return spark.createDataFrame([(*shares, 0 < kept.search(q, k=3, precision="medium").percent_searched < 50)], "exact double, list double, page double, filtered double, approximate boolean")


@register("negative_arguments", f"SELECT id, round({DISTANCE['cosine']}, 6) AS distance FROM {EQ} ORDER BY {DISTANCE['cosine']}, id LIMIT 4")
def negative_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative k or radius alone finds nothing; a negative radius leaves k as it is."""
    kept, q = stored(spark, sf_dir, "cosine"), query_vector(spark, sf_dir)
    nothing = [kept.search(q, **a).rows for a in ({"k": -1}, {"radius": -1.0}, {"k": -1, "radius": -1.0})]
    return shown(reduce(DataFrame.unionByName, [*nothing, kept.search(q, k=4, radius=-1.0).rows]))


@register("response_rows", f"SELECT id, label, round({DISTANCE['cosine']}, 6) AS distance FROM {EQ} WHERE label <> 0 AND {DISTANCE['cosine']} <= 0.45")
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service answers; records whose metadata is no JSON object, here those of
    label 0, are left out of it."""
    kept = stored(spark, sf_dir, "cosine", changed="CASE WHEN label = 0 THEN 'plain text' WHEN label = 1 THEN '{\"label\": 1}' ELSE metadata END")
    found = kept.search(query_vector(spark, sf_dir), radius=0.45).response()["results"]
    return spark.createDataFrame([(r["id"], int(r["metadata"]["label"]), r["distance"]) for r in found], "id long, label long, distance double").select("id", "label", six(F.col("distance")).alias("distance"))


@register("text_search", f"""
WITH d AS (SELECT doc_id, [{", ".join(f"(length(text) - length(replace(text, '{chr(97 + i)}', '')))::DOUBLE" for i in range(26))}] AS v FROM documents),
p AS (SELECT d.doc_id AS id, d.v, q.v AS q FROM d, (SELECT v FROM d WHERE doc_id = 1) q)
SELECT id, round({DISTANCE["euclidean"]}, 6) AS distance FROM p ORDER BY {DISTANCE["euclidean"]}, id LIMIT 10""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, embedder = table(spark, sf_dir, "documents"), LetterEmbedder()
    frame = docs.select(F.col("doc_id").alias("id"), embedded(F.col("text"), embedder).alias("vector"), F.lit(None).cast("string").alias("metadata"))
    text = docs.where("doc_id = 1").select("text").first()[0]
    return shown(search.nearest(frame, vectors.literal(embedder.embed([text])[0]), 10, "euclidean"))


# --- vectors ----------------------------------------------------------------------------


def _vector_query(name: str, sql: str, column: Callable[[Column, Column], Column], out: str) -> None:
    @register(name, f"SELECT id, {sql} AS {out} FROM {EQ}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = vectors.literal(query_vector(spark, sf_dir))
        return embeddings(spark, sf_dir).select("id", column(F.col("vector"), q).alias(out))


def _sixes(v: Column) -> Column:
    return F.transform(v, lambda x: F.round(x, 6) + 0.0)


_vector_query("vec_norm", "round(sqrt(list_inner_product(v, v)), 6)", lambda v, q: six(vectors.norm(v)), "norm")
_vector_query("vec_dot", "round(list_inner_product(v, q), 6)", lambda v, q: six(vectors.dot(v, q)), "dot")
_vector_query("vec_normalize", "list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0)", lambda v, q: _sixes(vectors.normalized(v)), "unit")
_vector_query("vec_midpoint", "list_transform(list_zip(v, q), lambda p: round((p[1] + p[2]) / 2, 6) + 0.0)", lambda v, q: _sixes(vectors.midpoint(v, q)), "middle")
_vector_query("vec_approx_equal", "list_max(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2]))) <= 1e-9", lambda v, q: vectors.approx_equal(v, q), "same")
_vector_query("vec_euclidean", f"round({DISTANCE['euclidean']}, 6)", lambda v, q: six(vectors.euclidean(v, q)), "distance")
_vector_query("vec_angular", f"round({DISTANCE['cosine']}, 6)", lambda v, q: six(vectors.angular(v, q)), "distance")

_NORMAL = vectors.random_unit(64, np.random.default_rng(5)).round(6).tolist()
_N_SQL = f"list_inner_product(v, {_NORMAL}::DOUBLE[])"
_ANGLE_SQL = f"acos({_N_SQL} / sqrt(list_inner_product(v, v))) / pi()"


@register("hyperplane_split_count", f'SELECT {_N_SQL} - 0.01 > 0 AS "right", count(*) AS records FROM {E} GROUP BY ALL')
def hyperplane_split_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.side_counts(embeddings(spark, sf_dir), vectors.literal(_NORMAL), 0.01, "euclidean")


@register("hyperplane_sides_cosine", f'SELECT id, {_ANGLE_SQL} > 0.5 AS "right", round(CASE WHEN {_ANGLE_SQL} > 0.5 THEN 1 - {_ANGLE_SQL} ELSE {_ANGLE_SQL} END, 6) AS distance FROM {E}')
def hyperplane_sides_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, distance = vectors.hyperplane_side(F.col("vector"), vectors.literal(_NORMAL), 0.0, "cosine")
    return embeddings(spark, sf_dir).select("id", right.alias("right"), six(distance).alias("distance"))


def _quantizer_queries(bits: int) -> None:
    top = (1 << bits) - 1
    codes = f"list_transform(v, lambda x: round((greatest(-1, least(1, x)) + 1) / 2 * {top})::INT)"
    back = f"list_transform({codes}, lambda c: c / {top}.0::DOUBLE * 2 - 1)"

    @register(f"quantize_{bits}", f"SELECT id, {codes} AS codes FROM {E}")
    def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
        return embeddings(spark, sf_dir).select("id", quantization.quantize(F.col("vector"), bits).alias("codes"))

    @register(f"dequantize_{bits}", f"SELECT id, list_transform({back}, lambda x: round(x, 6) + 0.0) AS vector FROM {E}")
    def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
        return embeddings(spark, sf_dir).select("id", _sixes(quantization.stored(F.col("vector"), bits)).alias("vector"))

    @register(f"knn_quantized_{bits}", f"SELECT id, round({DISTANCE['euclidean']}, 6) AS distance FROM (SELECT id, q, {back} AS v FROM {EQ}) ORDER BY {DISTANCE['euclidean']}, id LIMIT 10")
    def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = embeddings(spark, sf_dir).withColumn("vector", quantization.stored(F.col("vector"), bits))
        return shown(search.nearest(frame, vectors.literal(query_vector(spark, sf_dir)), 10, "euclidean"))

    @register(f"pack_{bits}", f"SELECT id, array_to_string(list_transform({codes}, lambda c: printf('%0{bits // 4}x', c)), '') AS packed FROM {E}")
    def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = quantization.packed_column(quantization.quantize(F.col("vector"), bits), bits)
        return embeddings(spark, sf_dir).select("id", F.lower(F.hex(packed)).alias("packed"))


    @register(f"unpack_{bits}", f"SELECT id, {codes} AS codes FROM {E}")
    def unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Packed in the JVM, unpacked again from the bytes."""
        packed = embeddings(spark, sf_dir).select("id", F.size("vector").alias("n"), quantization.packed_column(quantization.quantize(F.col("vector"), bits), bits).alias("packed"))
        return packed.select("id", quantization.unpacked_column(F.col("packed"), F.col("n"), bits).alias("codes"))


for _bits in (4, 8, 16):
    _quantizer_queries(_bits)


@register("quantize_64", f"SELECT id, list_transform(v, lambda x: round(x, 12) + 0.0) AS codes FROM {E}")
def quantize_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "cosine", 64).frame().select("id", F.transform("vector", lambda x: F.round(x, 12) + 0.0).alias("codes"))


@register("encoded_size", f"SELECT bits, CASE bits WHEN 4 THEN (d + 1) // 2 ELSE d * bits // 8 END AS bytes FROM (SELECT max(len(v)) AS d FROM {E}), (VALUES (4), (8), (16), (32), (64)) t(bits)")
def encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = len(query_vector(spark, sf_dir))
    return spark.createDataFrame([(b, quantization.encoded_size(d, b)) for b in quantization.BITS], "bits int, bytes long")


@register("quantize_32", f"SELECT id, list_transform(v, lambda x: round(x::FLOAT::DOUBLE, 6) + 0.0) AS codes FROM {E}")
def quantize_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("id", _sixes(quantization.stored(F.col("vector"), 32)).alias("codes"))


# --- the filter language --------------------------------------------------------------------


def _filter_query(name: str, text: str, sql: str, **kwargs) -> None:
    @register(name, f"SELECT doc_id FROM {DOCS_SQL} WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return passing(documents(spark, sf_dir), text, **kwargs).select("doc_id")


_filter_query("filter_eq", "lang == 'en'", "lang = 'en'")
_filter_query("filter_ne_missing", "quality != 1", "quality IS DISTINCT FROM 1")
_filter_query("filter_null", "quality == null", "quality IS NULL")
_filter_query("filter_range", "n_chars >= 1000 AND n_chars < 5000", "n_chars >= 1000 AND n_chars < 5000")
_filter_query("filter_string_order", "source > 'src2' AND source <= 'src7'", "source > 'src2' AND source <= 'src7'")
_filter_query("filter_and_or_not", "(lang == 'de' OR lang == 'fr') AND NOT (n_chars > 3000)", "lang IN ('de', 'fr') AND n_chars <= 3000")
_filter_query("filter_error_absorbs", "quality > 0 OR lang == 'en'", "quality IS NOT NULL AND (quality > 0 OR lang = 'en')")
_filter_query("filter_error_under_not", "NOT (toxic > 0)", "toxic IS NOT NULL AND toxic <= 0")
_filter_query("filter_kinds_differ", "n_chars == '1000' OR source == 7", "false")
_filter_query("filter_in", "source IN ['src1', 'src12', 'src3']", "source IN ('src1', 'src12', 'src3')")
_filter_query("filter_in_numbers", "quality IN [0, 2]", "coalesce(quality IN (0, 2), false)")
_filter_query("filter_not_in_missing", "quality NOT IN [1]", "coalesce(quality NOT IN (1), true)")
_filter_query("filter_in_array_field", "'src4' IN tags", "list_contains([lang, source], 'src4')")
_filter_query("filter_contains", "source CONTAINS '1'", "contains(source, '1')")
_filter_query("filter_starts", "source STARTS_WITH 'src1'", "starts_with(source, 'src1')")
_filter_query("filter_ends", "source ENDS_WITH '7'", "ends_with(source, '7')")
_filter_query("filter_matches", "source MATCHES '^src(1[0-5]|[2-4])$'", "regexp_matches(source, '^src(1[0-5]|[2-4])$')")
_filter_query("filter_matches_unanchored", "source MATCHES 'c1.'", "regexp_matches(source, 'c1.')")
_filter_query("filter_exists", "quality EXISTS", "quality IS NOT NULL")
_filter_query("filter_not_exists", "quality DOES NOT EXIST", "quality IS NULL")
_filter_query("filter_not_exists_call", "DOES_NOT_EXIST(toxic)", "toxic IS NULL")
_filter_query("filter_exists_quirk", "quality EXISTS", "true", quirks=True)
_filter_query("filter_exists_nested", "stats.origin.name EXISTS AND stats.nowhere DOES NOT EXIST", "true")
_filter_query("filter_nested", "stats.origin.name == 'src5' AND stats.chars > 500", "source = 'src5' AND n_chars > 500")
_filter_query("filter_index", "tags[1] == 'src9' OR items[0].n == 3", "source = 'src9' OR n_chars % 7 = 3")
_filter_query("filter_index_computed", "tags[toxic] == 'src3'", "coalesce(CASE toxic WHEN 0 THEN lang = 'src3' WHEN 1 THEN source = 'src3' END, false)")
_filter_query("filter_index_outside", "tags[5] == null", "true")
_filter_query("filter_length", "tags.length == 2 AND n_chars < 2000", "n_chars < 2000")
_filter_query("filter_array_equal", "tags == ['en', 'src3']", "lang = 'en' AND source = 'src3'")
_filter_query("filter_any", "ANY(items, n == 0)", "n_chars % 7 = 0 OR n_chars % 5 = 0")
_filter_query("filter_all", "ALL(items, n >= 2)", "n_chars % 7 >= 2 AND n_chars % 5 >= 2")
_filter_query("filter_length_fn", "LENGTH(source) == 5 AND LENGTH(tags) >= 2", "strlen(source) = 5")
_filter_query("filter_param", "n_chars > 100 AND quality == :toxic", "toxic IS NOT NULL AND n_chars > 100 AND quality = toxic")
_filter_query("filter_star", "tags[*] == ['de', 'src1']", "lang = 'de' AND source = 'src1'")
_filter_query("filter_root_not_bool", "n_chars", "false")


@register("filter_json_number", "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract_string(props, '$.k')::DOUBLE > 50")
def filter_json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.expr("try_parse_json(props)").alias("m"))
    return passing(events, "k > 50").select("event_id")


@register("filter_invalid_json", "SELECT event_id FROM events WHERE false")
def filter_invalid_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.expr("try_parse_json(concat('{', props))").alias("m"))
    return passing(events, "k > 50 OR k <= 50").select("event_id")


@register("filter_native", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value > 10 AND user_id >= 5")
def filter_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    columns = T.StructType([events.schema[c] for c in ("event_type", "value", "user_id")])
    return events.where(compile_filter(parse("event_type IN ['click', 'view'] AND value > 10 AND user_id >= 5"), NativeSource(columns))).select("event_id")


@register("filter_native_orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND (o_totalprice > 100000 OR o_orderpriority LIKE '1%')")
def filter_native_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = "NOT (o_orderstatus == 'F') AND (o_totalprice > 100000 OR o_orderpriority STARTS_WITH '1')"
    return orders.where(compile_filter(parse(text), NativeSource(orders.schema))).select("o_orderkey")


# --- records -------------------------------------------------------------------------------


def _updates(frame: DataFrame) -> DataFrame:
    """Each record of label 3 again, its vector turned round, under its own and a new id."""
    turned = frame.where("label = 3").select("id", F.transform("vector", lambda x: -x).alias("vector"), F.lit("{}").alias("metadata"))
    return turned.unionByName(turned.withColumn("id", F.col("id") + 1_000_000))


@register("upsert_merge", f"""
WITH old AS (SELECT id, v, '{{"label":' || label || '}}' AS metadata, label FROM {E}),
new AS (SELECT id + x AS id, list_transform(v, lambda y: -y) AS v, '{{}}' AS metadata FROM old, (VALUES (0), (1000000)) t(x) WHERE label = 3)
SELECT id, metadata, round(list_sum(v), 6) + 0.0 AS total FROM (
  SELECT id, v, metadata FROM old ANTI JOIN new USING (id) UNION ALL SELECT id, v, metadata FROM new)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = embeddings(spark, sf_dir)
    merged = records.upserted(frame.drop("label"), _updates(frame))
    return merged.select("id", "metadata", (six(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)) + 0.0).alias("total"))


@register("update_metadata", f"SELECT id, CASE WHEN label = 3 THEN '{{}}' ELSE '{{\"label\":' || label || '}}' END AS metadata FROM {E}")
def update_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = embeddings(spark, sf_dir)
    updates = _updates(frame).select("id", "metadata")
    return records.metadata_updated(frame, updates).select("id", "metadata")


@register("delete_docs", f"SELECT id FROM {E} WHERE label <> 3")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = embeddings(spark, sf_dir)
    return records.removed(frame, frame.where("label = 3")).select("id")


@register("latest_version", "SELECT user_id AS id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    return records.latest(events, "event_id")


@register("doc_count", f"SELECT count(*) AS documents FROM {E}")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"))


@register("list_ids", f"SELECT id FROM {E}")
def list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("id").orderBy("id")


@register("collection_stats", f"SELECT count(*) AS document_count, max(len(v))::INT AS dimension_count, 64 AS quantization, 'cosine' AS distance_method FROM {E}")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "cosine").stats().select("document_count", "dimension_count", "quantization", "distance_method")


@register("storage_size", f"SELECT 8 AS quantization, true AS smaller, true AS counted FROM {E} LIMIT 1")
def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bits take less room than 64, and the sizes are those of the files."""
    small, large = stored(spark, sf_dir, "cosine", 8), stored(spark, sf_dir, "cosine", 64)
    sizes = [c.stats().first().storage_size for c in (small, large)]
    files = small.stored_files().agg(F.sum("bytes")).first()[0]
    return spark.createDataFrame([(small.options.quantization, 0 < sizes[0] < sizes[1], sizes[0] >= files > 0)], "quantization int, smaller boolean, counted boolean")


_LABELLED: dict[tuple, Engine] = {}


@register("list_collections", f"SELECT 'label' || label AS name, count(*) AS document_count, max(len(v))::INT AS dimension_count FROM {E} GROUP BY label")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine with a collection for each label."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LABELLED:
        engine, rows = Engine(spark, table_path(spark, "engine")), embeddings(spark, sf_dir)
        d = len(query_vector(spark, sf_dir))
        for (label,) in rows.select("label").distinct().orderBy("label").collect():
            engine.create_collection(f"label{label}", d).upsert(rows.where(F.col("label") == label).drop("label"))
        _LABELLED[key] = engine
    return _LABELLED[key].list_collections().select("name", "document_count", "dimension_count")


@register("create_drop_collection", "SELECT name, there FROM (VALUES ('a', false), ('b', true), ('c', false)) t(name, there)")
def create_drop_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, table_path(spark, "engine"))
    for name in ("a", "b"):
        engine.create_collection(name, 3)
    dropped = engine.drop_collection("a"), engine.drop_collection("c")
    assert dropped == (True, False)
    return spark.createDataFrame([(n, n in engine and n in engine.names()) for n in "abc"], "name string, there boolean")


_CHANGED_SQL = f"""
WITH old AS (SELECT id, v, '{{"label":' || label || '}}' AS metadata, label FROM {E}),
new AS (SELECT id + x AS id, list_transform(v, lambda y: -y) AS v, '{{}}' AS metadata FROM old, (VALUES (0), (1000000)) t(x) WHERE label = 3),
merged AS (SELECT id, v, metadata FROM old ANTI JOIN new USING (id) UNION ALL SELECT id, v, metadata FROM new)
SELECT id, CASE WHEN id % 10 = 1 THEN '{{"seen":true}}' ELSE metadata END AS metadata, round(list_sum(v), 6) + 0.0 AS total FROM merged WHERE id % 10 <> 7"""


@register("collection_changes", _CHANGED_SQL)
def collection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection after an upsert, a metadata update and a removal, each a change of its own."""
    kept, frame = fresh(spark, sf_dir, "cosine"), embeddings(spark, sf_dir)
    kept.upsert(_updates(frame))
    ids = kept.frame().select("id")
    kept.update_metadata_batch(ids.where("id % 10 = 1").withColumn("metadata", F.lit('{"seen":true}')))
    kept.remove(ids.where("id % 10 = 7"))
    return kept.frame().select("id", "metadata", (six(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)) + 0.0).alias("total"))


@register("export_import", f"SELECT id, '{{\"label\":' || label || '}}' AS metadata, list_transform(v, lambda x: printf('%.6f', x)::DOUBLE + 0.0) AS vector FROM {E}")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection exported as JSON lines, and imported again: six decimals of its vectors stay."""
    path = table_path(spark, "export")
    exchange.export_folder(stored(spark, sf_dir, "cosine"), path)
    back = exchange.import_folder(spark, table_path(spark, "engine"), "back", path)
    return back.frame().select("id", "metadata", F.transform("vector", lambda x: x + 0.0).alias("vector"))


@register("highest_sequence", "SELECT user_id AS id, max(event_id) AS sequence FROM events GROUP BY user_id")
def highest_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("sequence"))


@register("export_records", f"SELECT id, '[' || array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') || ']' AS vector, '{{\"label\":' || label || '}}' AS metadata FROM {E}")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("id", vector_text(F.col("vector")).alias("vector"), F.to_json(F.parse_json("metadata")).alias("metadata"))


@register("checksum", "SELECT doc_id, md5(text) AS checksum FROM documents")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("checksum"))


# --- opening, files, requests, texts ------------------------------------------------------------


@register("open_modes", """SELECT mode, absent, present FROM (VALUES ('create_if_not_exists', 'made', 'kept'), ('read_write', 'KeyError', 'kept'),
    ('read_only', 'KeyError', 'PermissionError'), ('create_and_overwrite', 'made', 'emptied')) t(mode, absent, present)""")
def open_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode does where there is no collection, and where there is one with a record."""
    root, rows = table_path(spark, "engine"), []
    for mode in MODES:
        options = CollectionOptions(f"c_{mode}", "euclidean", 2)
        outcome = []
        try:
            outcome.append("made" if len(Collection.open(spark, root, options, mode)) == 0 else "?")
        except KeyError:
            outcome.append("KeyError")
            Collection.open(spark, root, options)
        Collection.open(spark, root, options).upsert([(1, [1, 2], None)])
        again = Collection.open(spark, root, options, mode)
        try:
            again.remove([2])
            outcome.append("kept" if len(again) == 1 else "emptied")
        except PermissionError:
            outcome.append("PermissionError")
        rows.append((mode, *outcome))
    return spark.createDataFrame(rows, "mode string, absent string, present string")


@register("stored_files", f"SELECT count(*) AS records, true AS sized FROM {E}")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "cosine").stored_files().agg(F.sum("records").alias("records"), F.bool_and(F.col("bytes") > 0).alias("sized"))


@register("csv_load", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id, n_name AS text, n_regionkey::VARCHAR AS region FROM nation")
def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "csv")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").coalesce(1).write.csv(path)
    made = Engine(spark, table_path(spark, "engine")).create_collection("nations", 16)
    exchange.load_csv(made, path, 1, {"text": 1, "region": 2})
    return made.frame().select("id", F.get_json_object("metadata", "$.text").alias("text"), F.get_json_object("metadata", "$.region").alias("region"))


@register("span_files", "SELECT n_nationkey::BIGINT AS id, '{\"name\":\"' || n_name || '\"}' AS metadata, [n_nationkey / 64.0::DOUBLE, n_regionkey / -8.0::DOUBLE] AS vector FROM nation WHERE n_nationkey <> 3")
def span_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a span file, one of them twice and one taken out, and imported."""
    path, root = table_path(spark, "spans"), table_path(spark, "engine")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    data = spans.write_span("", {0: json.dumps({"name": "n", "distance_method": 0, "dimension_count": 2, "quantization": 64}).encode()}, 0)
    for n, r in enumerate(rows):
        packed = quantization.pack([r.n_nationkey / 64, r.n_regionkey / -8], 64)
        if r.n_nationkey == 5:
            data += spans.write_span("5", {0: b"old", 1: packed}, 1)
        meta = json.dumps({"name": r.n_name}, separators=(",", ":")).encode()
        data += spans.write_span(str(r.n_nationkey), {0: meta, 1: packed}, 10 + n, n % 4, spans.FREE if r.n_nationkey == 3 else spans.ACTIVE)
    spans.write_file(path, data)
    return spans.import_spans(spark, root, "nations", path).frame().select("id", "metadata", "vector")


@register("request_search", f"SELECT id, label, round({DISTANCE['cosine']}, 6) AS distance FROM {EQ} WHERE label > 2 ORDER BY {DISTANCE['cosine']}, id LIMIT 7")
def request_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as the service is asked for it."""
    kept = stored(spark, sf_dir, "cosine")
    body = json.dumps({"vector": query_vector(spark, sf_dir), "k": 7, "filter": "label > 2"}).encode()
    status, found = service.handle(Engine(spark, kept.path.rpartition("/")[0]), "POST", f"/api/v1/collections/{kept.options.name}/search", body)
    assert status == 200, found
    return spark.createDataFrame([(r["id"], int(r["metadata"]["label"]), r["distance"]) for r in found["results"]], "id long, label long, distance double").select("id", "label", six(F.col("distance")).alias("distance"))


@register("filter_bound", "SELECT doc_id FROM documents WHERE n_chars >= 700 AND lang <> 'fr'")
def filter_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = bind(parse("n_chars >= :least AND NOT (lang == :not)"), {"least": 700, "not": "fr"})
    return documents(spark, sf_dir).where(compile_filter(node, VariantSource(F.col("m")))).select("doc_id")


_PRINTED = {
    "age >= 18 AND status == 'active'": "AND(>=(age, 18), ==(status, 'active'))",
    "NOT (a.b[0] != 1.5) OR name IN ['x', 2]": "OR(NOT(!=([](.(a, b), 0), 1.5)), IN(name, ['x', 2]))",
}


@register("filter_printed", "SELECT text, printed FROM (VALUES " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in _PRINTED.items()) + ") t(text, printed)")
def filter_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, str(parse(t))) for t in _PRINTED], "text string, printed string")


@register("embedding_cache", "SELECT 3::BIGINT AS asked, 2::BIGINT AS embedded, 100::BIGINT AS remembered, 26::BIGINT AS dimensions")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document's text is asked for twice, the second's once."""
    texts = [r.text for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(2).collect()]
    embed = QueryEmbedder(LetterEmbedder())
    found = [embed(t) for t in (texts[0], texts[0], texts[1] + "?")]
    info = embed.cache_info()
    return spark.createDataFrame([(info.hits + info.misses, info.misses, info.maxsize, len(found[0]))], "asked long, embedded long, remembered long, dimensions long")


@register("random_unit", "SELECT d AS dimensions, true AS unit, true AS seeded FROM (VALUES (1), (3), (64)) t(d)")
def random_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = lambda d: vectors.random_unit(d, np.random.default_rng(d)).tolist()
    frame = spark.createDataFrame([(d, draw(d), draw(d) == draw(d)) for d in (1, 3, 64)], "dimensions int, v array<double>, seeded boolean")
    return frame.select("dimensions", (F.abs(vectors.norm(F.col("v")) - 1) < 1e-12).alias("unit"), "seeded")
