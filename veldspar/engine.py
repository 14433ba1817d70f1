"""The catalogue of collections under one folder, and its configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection, CollectionOptions
from .embed import Embedder, HttpEmbedder
from .operators import records
from .sources.files import Files


@dataclass(frozen=True)
class EngineConfig:
    """Settings; from_env reads VELDSPAR_<NAME> for each that is set."""

    data_folder: str = "./data"
    default_precision: str = "exact"
    random_seed: int = 0
    reference_quirks: bool = False
    embedding_server: str = ""
    text_model: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            value = env.get(f"VELDSPAR_{f.name.upper()}")
            if value is not None:
                found[f.name] = int(value) if f.type == "int" else value.lower() in ("1", "true", "yes") if f.type == "bool" else value
        return cls(**found)


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | str | None = None, embedder: Embedder | None = None) -> None:
        self.spark = spark
        self.config = EngineConfig(config) if isinstance(config, str) else config or EngineConfig()
        self.embedder = embedder
        self.files = Files(spark, self.config.data_folder)

    def _kwargs(self, dimensions: int | None = None) -> dict:
        """``dimensions``: of the vectors, for the embedder that the settings name."""
        embedder = self.embedder
        if embedder is None and self.config.embedding_server and dimensions:
            embedder = HttpEmbedder(self.config.embedding_server, self.config.text_model, dimensions)
        return {"embedder": embedder, "default_precision": self.config.default_precision, "reference_quirks": self.config.reference_quirks, "seed": self.config.random_seed}

    def create_collection(self, name: str, vector_size: int, quantization: int = 64, distance_function: str = "cosine") -> Collection:
        """ValueError for bad options, and for a name that is taken."""
        options = CollectionOptions(name, distance_function, vector_size, quantization)
        if self.files.exists(f"{name}/options.json"):
            raise ValueError(f"there is a collection {name!r} already")
        return Collection.open(self.spark, self.config.data_folder, options, **self._kwargs(vector_size))

    def collection(self, name: str, mode: str = "read_write") -> Collection:
        found = json.loads(self.files.read(f"{name}/options.json")) if name in self else {}
        return Collection.open(self.spark, self.config.data_folder, name, mode, **self._kwargs(found.get("dimension_count")))

    def __contains__(self, name: str) -> bool:
        return self.files.exists(f"{name}/options.json")

    def names(self) -> list[str]:
        return [n for n in self.files.names() if n in self]

    def drop_collection(self, name: str) -> bool:
        """Whether there was one; dropping what isn't there is no error."""
        return self.files.delete(name) if name in self else False

    def list_collections(self, sample_pairs: int = 100) -> DataFrame:
        """Each collection's statistics, the one with most documents first, then by name. The
        counts and samples of all of them are one job."""
        found = [self.collection(n, "read_only") for n in self.names()]
        schema = "name string, document_count long, dimension_count int, quantization int, distance_method string, storage_size long, average_distance double"
        if not found:
            return self.spark.createDataFrame([], schema)
        frames = [c.frame().select(F.lit(c.options.name).alias("name"), F.lit(c.options.distance_method).alias("method"), "id", "vector") for c in found]
        rows = reduce(DataFrame.unionByName, frames)
        made = self.spark.createDataFrame([(c.options.name, c.options.dimension_count, c.options.quantization, c.options.distance_method, c.store.size(c.store.manifest())) for c in found], "name string, dimension_count int, quantization int, distance_method string, storage_size long")
        counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        means = records.sampled_pair_distances(rows, sample_pairs, self.config.random_seed)
        joined = made.join(counts, "name", "left").join(means, "name", "left")
        return joined.select("name", F.coalesce("n", F.lit(0)).alias("document_count"), "dimension_count", "quantization", "distance_method", "storage_size", F.coalesce("average_distance", F.lit(0.0)).alias("average_distance")).orderBy(F.desc("document_count"), "name")
