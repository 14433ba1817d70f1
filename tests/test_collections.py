"""Collections: life, changes, search façade, catalogue, exchange, embedding, streaming."""

import http.server
import io
import json
import random
import threading
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import storage
from veldspar.cli import main
from veldspar.collection import Collection, CollectionOptions
from veldspar.embed import HashingEmbedder, HttpEmbedder, LetterEmbedder, QueryEmbedder, embedded
from veldspar.engine import Engine, EngineConfig
from veldspar.sources import exchange
from veldspar.streaming.ingest import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "data"))


def ids(rows):
    return [r.id for r in rows.collect()]


def test_pages(engine):
    c = engine.create_collection("pages", 5)
    c.upsert([(i, [i * x for x in (0.1, 0.2, 0.3, 0.4, 0.5)], {"id": i}) for i in range(10)])
    pages = {(3, 0): [0, 1, 2], (3, 3): [3, 4, 5], (3, 6): [6, 7, 8], (3, 9): [9], (5, 7): [7, 8, 9], (20, 0): list(range(10)), (3, 20): []}
    for (limit, offset), wanted in pages.items():
        assert ids(c.search(limit=limit, offset=offset)) == wanted
    found = c.search(limit=3, offset=3)
    assert found.percent_searched == pytest.approx(60.0)
    assert c.search(filter="id >= 5").percent_searched == pytest.approx(50.0)
    # the zero vector is at distance 1 of everything
    assert c.search([0.1, 0.2, 0.3, 0.4, 0.5], k=10).collect()[-1].id == 0


def test_filtered_nearest_and_response(engine):
    c = engine.create_collection("f", 5)
    c.upsert([(1, [0.1, 0.2, 0.3, 0.4, 0.5], {"category": "A", "score": 80}), (2, [0.2, 0.3, 0.4, 0.5, 0.6], {"category": "B", "score": 90}), (3, [0.3, 0.4, 0.5, 0.6, 0.7], {"category": "A", "score": 70})])
    q = [0.1, 0.2, 0.3, 0.4, 0.5]
    assert ids(c.search(q, k=3, filter="category == 'A' AND score >= 75")) == [1]
    assert ids(c.search(q, k=3, filter=F.col("id") > 1)) == [2, 3]
    assert ids(c.search(q, k=3, filter=lambda i, m: json.loads(m)["score"] < 75)) == [3]
    answer = c.search(q, k=2).response()
    assert [r["id"] for r in answer["results"]] == [1, 2] and answer["results"][0]["metadata"] == {"category": "A", "score": 80}
    assert answer["percent_searched"] == 100 and set(answer) == {"results", "percent_searched", "search_time", "embedding_time"}
    with pytest.raises(ValueError):
        c.search(q, k=1, filter="category ==")


def test_modes_of_search(engine):
    c = engine.create_collection("m", 2, distance_function="euclidean")
    assert ids(c.search([50, 50], k=5)) == [] and c.search([50, 50], k=5).percent_searched == 0
    rng = np.random.default_rng(0)
    points = rng.uniform(0, 100, (10, 2))
    c.upsert([(i, p.tolist(), "metadata") for i, p in enumerate(points)])
    d = np.linalg.norm(points - 50, axis=1)
    order = np.argsort(d).tolist()
    assert ids(c.search([50, 50], k=5)) == order[:5]
    assert ids(c.search([50, 50], radius=30)) == [i for i in order if d[i] <= 30]
    assert ids(c.search([50, 50], radius=30, k=1)) == [i for i in order if d[i] <= 30]
    assert ids(c.search([50, 50], k=10, filter=F.col("id") % 2 == 0)) == [i for i in order if i % 2 == 0]
    assert ids(c.search([50, 50], k=10, filter="x == 1")) == []  # metadata that isn't JSON passes no filter
    for args in ({"k": -1}, {"radius": -1}, {"k": -1, "radius": -1}):
        assert ids(c.search([50, 50], **args)) == []
    assert len(ids(c.search([50, 50], radius=-1, k=3))) == 3
    for bad in ([1.0], [1.0, 2, 3], []):
        with pytest.raises(ValueError):
            c.search(bad, k=1)
    approximate = c.search([50, 50], k=3, precision="medium")
    assert set(ids(approximate)) <= set(range(10)) and 0 <= approximate.percent_searched <= 100
    assert set(ids(c.search([50, 50], radius=30, precision="medium", filter=F.col("id") > 2))) <= {i for i in order if d[i] <= 30 and i > 2}
    before = ids(approximate)
    c.build_index()
    assert c.has_index() and ids(c.search([50, 50], k=3, precision="medium")) == before
    assert c.search([50, 50], k=3, precision="medium", filter="x == 1").collect() == []
    c.remove([0])
    assert c.has_index() and 0 not in ids(c.search([50, 50], k=9, precision="medium")) and len(ids(c.search([50, 50], k=9, precision="medium"))) == 9


def test_ids_get_update_remove(engine):
    c = engine.create_collection("x", 3, distance_function="euclidean")
    c.upsert([(i, [i, i + 1, i + 2], "metadata") for i in range(40)])
    c.remove(range(0, 40, 10))
    assert ids_of(c) == [i for i in range(40) if i % 10]
    c.update_metadata(1, {"a": 1})
    assert json.loads(c.get(1).metadata) == {"a": 1} and c.get(1).vector == [1, 2, 3] and c.get(2).metadata == "metadata"
    c.remove_document(1)
    for act in (lambda: c.get(1), lambda: c.update_metadata(1, "{}"), lambda: c.remove_document(1)):
        with pytest.raises(KeyError):
            act()
    assert c.stored_files().agg(F.sum("records")).first()[0] == len(c) == 35
    c.create_view("x_view")
    assert c.spark.sql("SELECT count(*) FROM x_view WHERE id > 30").first()[0] == 9


def ids_of(c):
    return [r.id for r in c.ids().collect()]


def test_upsert_is_checked_and_whole(engine):
    c = engine.create_collection("u", 2)
    c.upsert([(1, [1, 2], None), (1, [3, 4], "last")])
    assert c.get(1).vector == [3, 4] and len(c) == 1
    for bad in ([(2, [1, 2], None), (3, [1], None)], [(-1, [1, 2], None)], [{"id": 4, "metadata": {}}]):
        with pytest.raises(ValueError):
            c.upsert(bad)
    assert len(c) == 1


def test_reopen_and_modes(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(KeyError):
        Collection.open(spark, root, "c")
    c = Collection.open(spark, root, CollectionOptions("c", "euclidean", 3, 4))
    c.upsert([(i, np.random.default_rng(i).random(3).tolist(), None) for i in range(10)])
    again = Collection.open(spark, root, CollectionOptions("c", "cosine", 7), "read_write")
    assert again.options == c.options and len(again.search([0.5] * 3, k=5).collect()) == 5
    levels = {round((x + 1) / 2 * 15, 6) for r in again.frame().collect() for x in r.vector}
    assert levels <= {float(i) for i in range(16)}
    reader = Collection.open(spark, root, "c", "read_only")
    with pytest.raises(PermissionError):
        reader.remove_document(1)
    fresh = Collection.open(spark, root, CollectionOptions("c", "cosine", 2), "create_and_overwrite")
    assert len(fresh) == 0 and fresh.options.dimension_count == 2
    c2 = Collection.open(spark, root, CollectionOptions("z", "euclidean", 3))
    c2.upsert([(1, [1, 2, 3], "larger metadata")])
    c2.remove([1])
    c2 = Collection.open(spark, root, "z", "read_write")
    c2.upsert([(5, [1, 2, 3], None)])
    assert ids_of(c2) == [5]


def test_options_are_checked():
    for bad in ({"name": ""}, {"name": "a/b"}, {"distance_method": "manhattan"}, {"dimension_count": 0}, {"quantization": 12}):
        with pytest.raises(ValueError):
            CollectionOptions(**({"name": "n", "dimension_count": 3} | bad))
    assert CollectionOptions("n", dimension_count=1, quantization=0).quantization == 64


def test_random_changes_against_a_dict(engine):
    rng, c, model = random.Random(0), engine.create_collection("model", 1), {}
    for step in range(8):
        puts = {rng.randrange(30): (float(rng.randint(1, 9)), f"v{step}") for _ in range(rng.randint(1, 8))}
        c.upsert([(i, [x], m) for i, (x, m) in puts.items()])
        model |= puts
        gone = [i for i in model if rng.random() < 0.2]
        c.remove(gone)
        for i in gone:
            del model[i]
        assert {r.id: (r.vector[0], r.metadata) for r in c.frame().collect()} == model


def test_catalogue(engine):
    engine.create_collection("a", 128)
    engine.create_collection("b", 64, 32, "euclidean").upsert([(1, [0.5] * 64, None), (2, [0.25] * 64, None)])
    rows = engine.list_collections().collect()
    assert [(r.name, r.document_count, r.dimension_count, r.quantization, r.distance_method) for r in rows] == [("b", 2, 64, 32, "euclidean"), ("a", 0, 128, 64, "cosine")]
    assert rows[0].storage_size > 0 and rows[0].average_distance >= 0
    with pytest.raises(ValueError):
        engine.create_collection("a", 3)
    with pytest.raises(ValueError):
        engine.create_collection("q", 3, distance_function="dot")
    assert engine.drop_collection("a") and not engine.drop_collection("a") and engine.names() == ["b"]
    assert Engine(engine.spark, engine.config.data_folder + "/none").list_collections().count() == 0


def test_config():
    assert EngineConfig.from_env({"VELDSPAR_DATA_FOLDER": "/x", "VELDSPAR_RANDOM_SEED": "7", "VELDSPAR_REFERENCE_QUIRKS": "true"}) == EngineConfig("/x", "exact", 7, True)


@pytest.mark.parametrize("precision", [6, None])
def test_export_import(engine, tmp_path, precision):
    c = engine.create_collection("e", 4, 32)
    c.upsert([(10, [1, 2, 3, 4], {"name": "ten", "n": [1, {"k": None}]}), (9, [0.5, 6, 7, 8], {"name": "nine"}), (2, [9, 10, 11, 12.125], None)])
    out = io.StringIO()
    exchange.export_json(c, out, precision)
    found = json.loads(out.getvalue())
    assert found["collection"] == {"name": "e", "distance_method": 1, "dimension_count": 4, "quantization": 32}
    assert [r["id"] for r in found["records"]] == [2, 9, 10]
    back = exchange.import_json(engine.spark, engine.config.data_folder, "back", io.StringIO(out.getvalue()))
    same = lambda x: sorted((r.id, r.vector, json.loads(r.metadata or "null")) for r in x.frame().collect())
    assert same(back) == same(c) and back.options.quantization == 32
    folder = str(tmp_path / "out")
    exchange.export_folder(c, folder, precision)
    assert same(exchange.import_folder(engine.spark, engine.config.data_folder, "back2", folder)) == same(c)


#: Halves in binary, decimals that only look like halves, and numbers that a shortest text hides.
HALVES = [9 / 128, -9 / 128, 3 / 128, 1 / 128, 0.1234565, -0.1234575, 5e-7, 2.0**33 + 1 / 128, 1e23, -1e-9, -0.0, 0.9999995]


def test_decimals_are_those_of_sql(spark):
    shown = duckdb.sql(f"SELECT '[' || array_to_string(list_transform({[str(x) for x in HALVES]}::DOUBLE[], lambda x: printf('%.6f', x)), ',') || ']'").limit(1).fetchall()[0][0]
    frame = spark.createDataFrame([(1, HALVES), (2, None), (3, [None, float("nan"), float("-inf")]), (4, [])], "id long, v array<double>")
    got = {r.id: r.t for r in frame.select("id", exchange.vector_text(F.col("v")).alias("t")).collect()}
    assert got == {1: shown, 2: None, 3: "[null,NaN,-Infinity]", 4: "[]"} and shown.startswith("[0.070312,-0.070312,0.023438,0.007812,")


def test_decimals_of_sql_come_back(engine, tmp_path):
    c, folder = engine.create_collection("h", len(HALVES)), str(tmp_path / "out")
    c.upsert([(1, HALVES, None)])
    exchange.export_folder(c, folder)
    back = exchange.import_folder(engine.spark, engine.config.data_folder, "back", folder)
    (wanted,) = duckdb.sql(f"SELECT list_transform({[str(x) for x in HALVES]}::DOUBLE[], lambda x: printf('%.6f', x)::DOUBLE)").limit(1).fetchall()[0]
    assert back.get(1).vector == wanted and wanted[0] == 0.070312


def test_import_errors(engine):
    for bad in ('{"records": [], "collection": {}}', '{"collection": {}, "more": 1}', '{"records": []}', "[]"):
        with pytest.raises(ValueError):
            exchange.import_json(engine.spark, engine.config.data_folder, "i", io.StringIO(bad))
    c = engine.create_collection("bad", 1)
    c.upsert([(1, [1], "not json")])
    with pytest.raises(Exception):  # noqa: B017
        exchange.export_json(c, io.StringIO())


def test_texts(spark, tmp_path):
    class FiveNumbers:
        dimensions = 5

        def embed(self, texts):
            return [[0.1, 0.2, 0.3, 0.4, 0.5] for _ in texts]

    c = Engine(spark, str(tmp_path), FiveNumbers()).create_collection("t", 5)
    c.upsert([{"id": 1, "text": "one", "metadata": {"k": "v"}}, {"id": 2, "text": "two", "vector": [5, 4, 3, 2, 1]}])
    assert c.get(1).vector == [0.1, 0.2, 0.3, 0.4, 0.5] and c.get(2).vector == [5, 4, 3, 2, 1]
    assert ids(c.search([9, 9, 9, 9, 9], text="q", k=1)) == [1]


def test_embedders(spark):
    e = HashingEmbedder(32)
    assert e.embed(["a b"]) == e.embed(["B  a"]) and np.linalg.norm(e.embed(["x y"])[0]) == pytest.approx(1) and not any(e.embed([""])[0])
    q = QueryEmbedder(e)
    q("a"), q("a"), q("b")
    assert q.cache_info().hits == 1 and q.cache_info().maxsize == 100
    row = spark.createDataFrame([("abca",)], "t string").select(embedded(F.col("t"), LetterEmbedder()).alias("v")).first()
    assert row.v == LetterEmbedder().embed(["abca"])[0]


def test_csv_and_batches(engine, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('0,x,"hello, there"\n1,y,more\n2,z,\n')
    c = engine.create_collection("csv", 16)
    assert exchange.load_csv(c, str(path), 2, {"user": 1}) == 2
    assert exchange.load_csv(c, str(path), 2) == 2 and len(c) == 4
    assert [len(b) for b in exchange.batches(range(250))] == [100, 100, 50]


def test_command_line(engine, tmp_path, capsys):
    engine.create_collection("k", 2).upsert([(1, [1, 2], {})])
    folder, out = engine.config.data_folder, str(tmp_path / "k.json")
    main(["--data-folder", folder, "--export", "k", "--output", out], engine.spark)
    main(["--data-folder", folder, "--import", out, "--name", "k2"], engine.spark)
    main(["--data-folder", folder, "--list"], engine.spark)
    main(["--data-folder", folder, "--dump", "k2"], engine.spark)
    shown = capsys.readouterr().out
    assert "k\t1\t2\t64\tcosine" in shown and "k2\t1\t2" in shown and ".parquet\t" in shown


def test_streaming_ingest(engine, tmp_path):
    c = engine.create_collection("s", 2)
    source = str(tmp_path / "in")
    schema = "id long, vector array<double>, metadata string"
    for n in range(2):
        engine.spark.createDataFrame([(n, [1.0, float(n)], "{}"), (9, [float(n), n + 1.0], None)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, c, str(tmp_path / "cp")).awaitTermination()
    assert ids_of(c) == [0, 1, 9]


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0])
def test_approximate_search_at_any_scale(engine, scale):
    rng = np.random.default_rng(4)
    data = np.concatenate([c + rng.normal(size=(50, 16)) * 0.3 for c in rng.normal(size=(20, 16)) * 2]) * scale
    c = engine.create_collection("scales", 16, distance_function="euclidean")
    c.upsert([(i, v.tolist(), {}) for i, v in enumerate(data)])
    c.build_index()
    found = searched = 0
    for i in range(0, 1000, 125):
        best = np.argsort(np.linalg.norm(data - data[i], axis=1))[:10].tolist()
        near = c.search(data[i].tolist(), k=10, precision="medium")
        found += len(set(best) & set(ids(near)))
        searched += near.percent_searched
    assert found >= 72 and searched / 8 < 60
    d = np.linalg.norm(data - data[3], axis=1)
    wide = float(np.sort(d)[400])
    assert len(ids(c.search(data[3].tolist(), radius=wide, precision="medium"))) >= 0.9 * (d <= wide).sum()


# --- approximate search with nothing set --------------------------------------------------

FIXTURES = {
    # name: distance, k, vectors, query, and less than so much of 100 is to be searched
    "C1": ("cosine", 10, lambda rng: rng.random((20_000, 3)), lambda rng: rng.random(3), 20),
    "C2": ("euclidean", 5, lambda rng: rng.random((100, 3)) * 100, lambda rng: rng.random(3) * 100, 100.1),
    "C6": ("euclidean", 5, lambda rng: rng.random((10, 2)) * 100, lambda rng: np.array([50.0, 50.0]), 100.1),
    "C7": ("cosine", 5, lambda rng: np.arange(1000)[:, None] + np.arange(3.0), lambda rng: np.array([50.0, 51, 52]), 50),
    "far": ("euclidean", 10, lambda rng: rng.normal(size=(3000, 32)) + 1e5, lambda rng: rng.normal(size=32) + 1e5, 60),
}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_approximate_search_of_the_fixtures(engine, name):
    method, k, make, ask, most = FIXTURES[name]
    rng = np.random.default_rng(0)
    data = make(rng)
    c = engine.create_collection(name, data.shape[1], distance_function=method)
    c.upsert(engine.spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(data)], "id long, vector array<double>, metadata string"))
    hits = 0
    for _ in range(4):
        q = ask(rng).tolist()
        near, true = c.search(q, k=k, precision="medium"), c.search(q, k=k)
        got, wanted = near.collect(), true.collect()
        assert len(got) == len(wanted) == k and near.percent_searched < most and true.percent_searched == 100
        assert all(a.distance <= 2 * b.distance + 1e-9 for a, b in zip(got, wanted))
        hits += len({r.id for r in got} & {r.id for r in wanted})
    assert hits >= 0.9 * 4 * k
    radius = wanted[-1].distance
    assert len(ids(c.search(q, radius=radius, precision="medium"))) >= 0.9 * len(ids(c.search(q, radius=radius)))
    queries = engine.spark.createDataFrame([(i, data[i].tolist()) for i in range(0, len(data), max(1, len(data) // 25))], "query_id long, vector array<double>")
    batch, exact = c.search_batch_approximate(queries, k).collect(), c.search_batch(queries, k).collect()
    assert len(batch) == len(exact)
    assert len({(r.query_id, r.id) for r in batch} & {(r.query_id, r.id) for r in exact}) >= 0.9 * len(exact)


def test_approximate_search_of_odd_collections(engine):
    for method in ("cosine", "euclidean"):
        c = engine.create_collection(f"odd-{method}", 3, distance_function=method)
        assert c.search([1, 2, 3], k=4, precision="medium").collect() == [] and not c.has_index()
        c.upsert([(1, [0, 0, 0], None), (2, [1, 1, 1], "{}"), (3, [1, 1, 1], None), (4, [-1, -1, -1], None)])
        for q in ([1, 1, 1], [0, 0, 0], [-5, 2, 0]):
            for k in (1, 4):
                exact, near = c.search(q, k=k), c.search(q, k=k, precision="medium")
                assert [(r.id, r.distance) for r in near.collect()] == [(r.id, r.distance) for r in exact.collect()]
            for radius in (0.1, 1.0):
                assert ids(c.search(q, radius=radius, precision="medium")) == ids(c.search(q, radius=radius))
        assert ids(c.search([1, 1, 1], k=2, precision="medium", filter=F.col("id") > 2)) == ids(c.search([1, 1, 1], k=2, filter=F.col("id") > 2))


def test_seeds_come_from_the_settings(spark, tmp_path):
    made = [Engine(spark, EngineConfig(str(tmp_path / str(n)), random_seed=seed)).create_collection("s", 4) for n, seed in enumerate((7, 7, 8))]
    for c in made:
        c.upsert([(i, [i, 1, 2, i % 3], None) for i in range(20)])
    sketches = [sorted(map(str, c.store.rows(c.store.manifest()).select("id", "_s0").collect())) for c in made]
    assert sketches[0] == sketches[1] != sketches[2]


# --- changes ------------------------------------------------------------------------------


def test_a_change_writes_what_it_changes(engine):
    c = engine.create_collection("large", 8, distance_function="euclidean")
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), "{}") for i, v in enumerate(rng.normal(size=(5000, 8)))]
    c.upsert(engine.spark.createDataFrame(rows, "id long, vector array<double>, metadata string"))
    base, size = c.store.manifest().base, c.store.size(c.store.manifest())
    c.upsert([(17, [1.0] * 8, "new"), (9999, [2.0] * 8, None)])
    c.update_metadata(18, {"a": 1})
    c.remove([19, 123456])
    now = c.store.manifest()
    assert now.base == base and len(now.changes) == 3 and c.store.size(now) - size < size / 5
    assert len(c) == 5000 and c.get(17).vector == [1.0] * 8 and c.get(17).metadata == "new" and json.loads(c.get(18).metadata) == {"a": 1} and c.get(18).vector == pytest.approx(rows[18][1])
    with pytest.raises(KeyError):
        c.get(19)
    assert c.has_index() and ids(c.search([2.0] * 8, k=1, precision="medium")) == [9999]
    assert ids(c.search([1.0] * 8, k=1, precision="medium")) == [17]
    before = {r.id: (tuple(r.vector), r.metadata) for r in c.frame().collect()}
    old = c.frame()
    c.compact()
    after = c.store.manifest()
    assert after.changes == () and after.base != base and {r.id: (tuple(r.vector), r.metadata) for r in c.frame().collect()} == before
    assert old.count() == 5000  # a reader of the version before
    c.vacuum()
    folders = [n for n in c.files.names() if n.startswith("d-")]
    assert folders == [after.base] and len(c) == 5000 and not [n for n in c.files.names() if n.startswith("stage-")]


def test_changes_are_folded_once_they_have_grown(engine, monkeypatch):
    monkeypatch.setattr(storage, "MOST_CHANGES", 3)
    monkeypatch.setattr(storage, "CHANGED_SHARE", 100)
    c = engine.create_collection("many", 2)
    model, seen = {}, []
    for n in range(8):
        c.upsert([(n % 3, [n, 1], str(n)), (100 + n, [1, n], None)])
        model |= {n % 3: str(n), 100 + n: None}
        seen.append(len(c.store.manifest().changes))
    assert seen == [0, 1, 2, 0, 1, 2, 0, 1]
    assert {r.id: r.metadata for r in c.frame().collect()} == model


def test_metadata_after_put_and_removal(engine):
    c = engine.create_collection("order", 1)
    c.upsert([(i, [1], "first") for i in range(200)])
    c.update_metadata(1, '"m1"')
    c.upsert([(1, [2], "second"), (2, [2], "second")])
    c.update_metadata(2, '"m2"')
    c.remove([3, 2])
    c.update_metadata_batch(c.spark.createDataFrame([(3, "ghost"), (4, None), (5, "a"), (5, "b"), (None, "x")], "id long, metadata string"))
    c.upsert([(3, [9], None)])
    got = {r.id: (r.vector, r.metadata) for r in c.frame().where("id < 7").collect()}
    assert got == {0: ([1], "first"), 1: ([2], "second"), 3: ([9], None), 4: ([1], None), 5: ([1], "b"), 6: ([1], "first")}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    options = CollectionOptions("shared", "euclidean", 2)
    Collection.open(spark, str(tmp_path), options)
    failed = []

    def write(n):
        try:
            Collection.open(spark, str(tmp_path), "shared").upsert([(n, [n, n], f"by {n}"), (1000 + n, [n, 0], None)])
        except Exception as problem:  # noqa: BLE001
            failed.append(problem)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(12)]
    [t.start() for t in threads], [t.join() for t in threads]
    c = Collection.open(spark, str(tmp_path), "shared")
    assert not failed and ids_of(c) == [*range(12), *range(1000, 1012)]
    compacting = threading.Thread(target=c.build_index)
    compacting.start(), write(50), compacting.join()
    assert not failed and len(c) == 26 and ids(c.search([50, 50], k=1, precision="medium")) == [50]


def test_texts_are_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting:
        dimensions = 1

        def embed(self, texts):
            for t in texts:
                (calls / f"{t}-{uuid.uuid4().hex}").touch()
            return [[float(len(t))] for t in texts]

    c = Engine(spark, str(tmp_path / "d"), Counting()).create_collection("t", 1)
    c.upsert(spark.createDataFrame([(i, "x" * i) for i in range(1, 9)], "id long, text string"))
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["x" * i for i in range(1, 9)] and len(c) == 8


def test_bound_parameters(engine):
    c = engine.create_collection("p", 1)
    c.upsert([(i, [1], {"n": i, "s": f"v{i}", "limit": 2}) for i in range(6)])
    assert ids(c.search(filter="n >= :least AND s != :not", params={"least": 3, "not": "v4"})) == [3, 5]
    assert ids(c.search(filter="n >= :limit")) == [2, 3, 4, 5] and ids(c.search(filter="n >= :limit", params={"limit": 5})) == [5]
    assert ids(c.search(filter=":wanted == n OR s == :s", params={"wanted": 1, "s": "x' OR true"})) == [1]
    assert ids(c.search(filter="n == :none", params={"none": None})) == []


def test_embedding_by_http(spark, tmp_path):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path != "/api/embed" or asked["model"] != "m":
                self.send_error(404)
                return
            body = json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode()
            self.send_response(200), self.end_headers(), self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    where = f"127.0.0.1:{server.server_port}"
    c = Engine(spark, EngineConfig(str(tmp_path), embedding_server=where, text_model="m")).create_collection("h", 2, distance_function="euclidean")
    c.upsert([{"id": i, "text": "x" * i} for i in range(1, 50)])
    assert c.get(7).vector == [7.0, 1.0] and ids(c.search(text="y" * 9, k=1)) == [9]
    with pytest.raises(ValueError):
        HttpEmbedder(where, "m", 3).embed(["a"])
    with pytest.raises(OSError):
        HttpEmbedder(where, "other", 2).embed(["a"])
    server.shutdown()
