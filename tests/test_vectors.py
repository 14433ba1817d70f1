"""Vector functions, quantisation and search against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldspar.functions import quantization as Q
from veldspar.functions import vectors as V
from veldspar.operators import lsh, records, search


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    data[7] = 0
    data[9] = data[8]
    frame = spark.createDataFrame([(i, v.tolist(), "{}") for i, v in enumerate(data)], "id long, vector array<double>, metadata string").cache()
    return data, frame


def test_known_distance(spark):
    row = spark.range(1).select(V.euclidean(V.literal([1.0, 2, 3]), V.literal([4.0, 5, 6])).alias("d")).first()
    assert row.d == pytest.approx(5.196152422706632, abs=1e-12)


def test_scalars(cloud):
    data, frame = cloud
    q = np.arange(8.0)
    ql = V.literal(q)
    v = F.col("vector")
    rows = frame.select("id", V.norm(v).alias("n"), V.dot(v, ql).alias("d"), V.normalized(v).alias("u"), V.midpoint(v, ql).alias("m"), V.euclidean(v, ql).alias("e"), V.angular(v, ql).alias("a"), V.approx_equal(v, v).alias("same"), V.angular(v, v).alias("self")).collect()
    for r in rows:
        x = data[r.id]
        assert r.n == pytest.approx(np.linalg.norm(x)) and r.d == pytest.approx(x @ q)
        assert np.allclose(r.u, x / (np.linalg.norm(x) or 1)) and np.allclose(r.m, (x + q) / 2)
        assert r.e == pytest.approx(np.linalg.norm(x - q))
        assert r.same and r.self == (1.0 if r.id == 7 else pytest.approx(0, abs=1e-7))
        assert r.a == pytest.approx(V.distances(x[None], q[None], "cosine")[0, 0])


def test_approx_equal_needs_one_length(spark):
    row = spark.range(1).select(V.approx_equal(V.literal([1.0]), V.literal([1.0, 2.0])).alias("a"), V.approx_equal(V.literal([1.0]), V.literal([1.0 + 1e-10])).alias("b")).first()
    assert (row.a, row.b) == (False, True)


@pytest.mark.parametrize("bits", Q.BITS)
def test_quantizer(spark, bits):
    values = [-3.0, -1.0, -0.5, 0.0, 0.1, 0.999, 1.0, 2.0, 0.25]
    row = spark.range(1).select(Q.quantize(V.literal(values), bits).alias("c"), Q.stored(V.literal(values), bits).alias("s")).first()
    if bits <= 16:
        top = 2**bits - 1
        assert row.c == [int(np.floor((min(1, max(-1, x)) + 1) / 2 * top + 0.5)) for x in values]
        assert np.allclose(row.s, [c / top * 2 - 1 for c in row.c])
        packed = spark.range(1).select(Q.packed_column(Q.quantize(V.literal(values), bits), bits).alias("p")).first().p
        assert bytes(packed) == Q.pack(row.c, bits)
    else:
        assert np.allclose(row.s, values, atol=1e-6)
    assert len(Q.pack(row.c, bits)) == Q.encoded_size(len(values), bits)
    assert Q.unpack(Q.pack(row.c, bits), len(values), bits).tolist() == list(row.c)


def test_bits_are_checked():
    for bad in (0, 1, 12, 128):
        with pytest.raises(ValueError):
            Q.encoded_size(3, bad)


@pytest.mark.parametrize("method", V.METHODS)
def test_search_against_brute_force(cloud, method):
    data, frame = cloud
    q = data[8]
    d = V.distances(data, q[None], method)[:, 0].round(9)
    order = np.lexsort((np.arange(300), d))
    got = search.nearest(frame, V.literal(q), 12, method).collect()
    assert [r.id for r in got] == order[:12].tolist() and got[0].id == 8 and got[1].id == 9
    radius = float(np.sort(d)[40]) + 1e-6
    assert [r.id for r in search.within(frame, V.literal(q), radius, method).collect()][:3] == order[:3].tolist()
    assert {r.id for r in search.within(frame, V.literal(q), radius, method).collect()} == set(np.flatnonzero(d <= radius).tolist())
    filtered = search.nearest(frame, V.literal(q), 5, method, F.col("id") % 2 == 1).collect()
    assert [r.id for r in filtered] == [i for i in order.tolist() if i % 2][:5]


@pytest.mark.parametrize("limit", [search.QUERY_BYTES, 0])
def test_batch_search(spark, cloud, monkeypatch, limit):
    monkeypatch.setattr(search, "QUERY_BYTES", limit)
    data, frame = cloud
    queries = frame.where("id < 20").select(F.col("id").alias("query_id"), "vector")
    for method in V.METHODS:
        got = {(r.query_id, r["rank"]): r.id for r in search.nearest_batch(frame, queries, 4, method).collect()}
        d = V.distances(data, data[:20], method).round(9)
        for j in range(20):
            if j in (7, 8, 9):
                continue
            assert [got[j, n] for n in range(1, 5)] == np.lexsort((np.arange(300), d[:, j]))[:4].tolist()
    assert search.nearest_batch(frame, queries.where("false"), 3, "cosine").count() == 0


def test_topk_is_planned_as_such(cloud):
    plan = search.nearest(cloud[1], V.literal(np.ones(8)), 3, "euclidean")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_list_order(spark):
    frame = spark.createDataFrame([(i, [1.0], None) for i in range(12)], "id long, vector array<double>, metadata string")
    assert [r.id for r in search.listed(frame).collect()] == [0, 1, 10, 11, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.id for r in search.listed(frame, None, 9, 5, "numeric").collect()] == [9, 10, 11]


@pytest.mark.parametrize("method", V.METHODS)
def test_candidates_are_rarely_missed(spark, method):
    """Of records within the limit at most one in twenty is no candidate, at any distance."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(4000, 24)) * rng.uniform(0.5, 2, size=(4000, 1))
    frame = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(data)], "id long, vector array<double>, metadata string")
    sketcher = lsh.Sketcher(method, 24, 0, lsh.centre_of(frame, method, 24))
    sketched = sketcher.sketched(frame).cache()
    for q in (data[5], rng.normal(size=24)):
        d = V.distances(data, q[None], method)[:, 0]
        r, words = sketcher.sketch(data)
        rq, wq = sketcher.sketch(q[None])
        for share in (0.002, 0.02, 0.2, 0.6):
            limit = float(np.quantile(d, share))
            found = {r.id for r in sketched.where(sketcher.candidate(q, limit)).collect()}
            within = set(np.flatnonzero(d <= limit).tolist())
            assert len(within & found) >= 0.95 * len(within) - 1 and len(found) < 4000
            assert found == set(np.flatnonzero(sketcher._could(r, words, rq[0], wq[0], limit)).tolist())


def test_sketches_without_vectors(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id long, vector array<double>")
    got = {r.id: r for r in lsh.Sketcher("cosine", 2).sketched(frame).collect()}
    assert got[1]._r == pytest.approx(1) and got[2]._r is None and got[2]._s0 is None and got[3]._r == -1
    assert lsh.centre_of(frame, "cosine", 2) == pytest.approx((0.6, 0.8)) and lsh.centre_of(frame, "euclidean", 2) == pytest.approx((1.5, 2.0))
    assert lsh.centre_of(frame.where("false"), "cosine", 2) == ()


def test_batches_never_meet_in_a_join(cloud, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 0)
    _, frame = cloud
    queries = frame.where("id < 20").select(F.col("id").alias("query_id"), "vector")
    plan = search.nearest_batch(frame, queries, 4, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and plan.count("MapInArrow") > 1


@pytest.mark.parametrize("limit", [search.QUERY_BYTES, 2000])
def test_mean_of_all_pairs(cloud, monkeypatch, limit):
    monkeypatch.setattr(search, "QUERY_BYTES", limit)
    data, frame = cloud
    for method in V.METHODS:
        d = V.distances(data, data, method)
        wanted = d[np.triu_indices(len(data), 1)].mean()
        found = records.mean_pair_distance(frame, method)
        assert found.first()[0] == pytest.approx(wanted, rel=1e-9) and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert records.mean_pair_distance(frame.where("id = 1"), "cosine").first()[0] == 0 == records.mean_pair_distance(frame.where("false"), "cosine").first()[0]


def _batches(data, ids, size):
    rows = pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.array(data.tolist(), pa.list_(pa.float64()))})
    return rows.to_batches(max_chunksize=size)


def _odd_clouds():
    rng = np.random.default_rng(11)
    cloud = rng.normal(size=(600, 8))
    copies = cloud[rng.integers(0, 40, 600)]
    zeros = cloud * (rng.random(600) < 0.7)[:, None]
    return {"cloud": cloud, "copies": copies, "far off": cloud * 1e-3 + 1e4, "tiny": cloud * 1e-25, "huge": cloud * 1e25, "zeros": zeros, "one": np.ones((600, 8)), "mixed": cloud * 10.0 ** rng.integers(-20, 20, 600)[:, None]}


@pytest.mark.parametrize("method", V.METHODS)
@pytest.mark.parametrize("name", sorted(_odd_clouds()))
def test_rough_products_lose_no_neighbour(name, method):
    """Whatever the scale, the k nearest by measured distances, ties by id, in batches of any size."""
    data, ids = _odd_clouds()[name], np.random.default_rng(12).permutation(600)
    queries = data[:50]
    for k, size in ((1, 600), (5, 100), (7, 3), (700, 250)):
        (got,) = search._top(k, method)(ids[:50], queries)(iter(_batches(data, ids, size)))
        got = [tuple(r.values()) for r in got.to_pylist()]
        for j in range(50):
            d = V.pair_distances(data, np.repeat(queries[j : j + 1], 600, axis=0), method)
            order = np.lexsort((ids, d))[:k]
            assert [x for x in got if x[0] == ids[j]] == [(ids[j], ids[i], d[i]) for i in order]
    (none,) = search._top(0, method)(ids[:50], queries)(iter(_batches(data, ids, 600)))
    assert none.num_rows == 0


@pytest.mark.parametrize("method", V.METHODS)
def test_few_pairs_are_measured(monkeypatch, method):
    """Once a query has k rows, rough products leave few others to measure: before, k for each batch."""
    rng, measured = np.random.default_rng(13), []
    pairs = V.pair_distances
    monkeypatch.setattr(V, "pair_distances", lambda a, b, method: measured.append(len(a)) or pairs(a, b, method))
    data = rng.normal(size=(8000, 16))
    (got,) = search._top(5, method)(np.arange(100), data[:100])(iter(_batches(data, np.arange(8000), 100)))
    assert got.num_rows == 500 and 500 <= sum(measured) < 100 * 80 * 5 / 4


@pytest.mark.parametrize("method", V.METHODS)
def test_pairs_are_measured_once(spark, cloud, monkeypatch, method):
    """Slices meet themselves and those before them: little more than half of the distances."""
    monkeypatch.setattr(search, "QUERY_BYTES", 2000)
    data, frame = cloud
    measured, multiplied, sums = 0, V.multiplied_distances, []

    def counted(left, right, method):
        nonlocal measured
        measured += len(left) * len(right)
        return multiplied(left, right, method)

    monkeypatch.setattr(V, "multiplied_distances", counted)
    for s, slices, ids, matrix in search.query_slices(frame.withColumnRenamed("id", "query_id")):
        rows = frame.select("id", "vector", search.slice_number(F.col("id"), slices).alias("slice")).toArrow()
        sums += [b.to_pylist()[0] for b in records._pair_sums(s, ids, matrix, method)(rows.to_batches())]
    assert sum(x["n"] for x in sums) == 300 * 299 // 2 and measured < 0.6 * 300 * 300
    assert sum(x["total"] for x in sums) == pytest.approx(V.distances(data, data, method)[np.triu_indices(300, 1)].sum(), rel=1e-9)


def test_one_file_is_dealt_to_all_tasks(spark, monkeypatch):
    """Of a table in one partition, that many slices pass over, each task has a share."""
    monkeypatch.setattr(search, "QUERY_BYTES", 50_000)
    frame = spark.range(20_000, numPartitions=1).select("id", F.array(F.rand(1), F.rand(2)).alias("vector")).localCheckpoint()
    plan = records.mean_pair_distance(frame, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "REPARTITION_BY_NUM" in plan
    assert records.mean_pair_distance(frame, "cosine").first()[0] == pytest.approx(records.mean_pair_distance(frame.repartition(3), "cosine").first()[0])


def test_vectors_must_be_there(spark):
    for bad in ([(1, [1.0, 2.0]), (2, None)], [(1, [1.0, 2.0]), (2, [1.0])]):
        with pytest.raises(ValueError):
            records.mean_pair_distance(spark.createDataFrame(bad, "id long, vector array<double>"), "cosine").collect()


def test_record_operators(spark):
    old = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b"), (3, [3.0], None)], "id long, vector array<double>, metadata string")
    new = spark.createDataFrame([(2, [9.0], "n"), (4, [4.0], "d")], old.schema)
    assert sorted(map(tuple, records.upserted(old, new).collect())) == [(1, [1.0], "a"), (2, [9.0], "n"), (3, [3.0], None), (4, [4.0], "d")]
    assert sorted(r.id for r in records.removed(old, new).collect()) == [1, 3]
    updated = {r.id: (r.vector, r.metadata) for r in records.metadata_updated(old, spark.createDataFrame([(1, None), (8, "x")], "id long, metadata string")).collect()}
    assert updated == {1: ([1.0], None), 2: ([2.0], "b"), 3: ([3.0], None)}
    seq = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z")], "id long, _seq long, v string")
    assert sorted(r.v for r in records.latest(seq).collect()) == ["y", "z"]
    assert records.mean_pair_distance(old, "euclidean").first()[0] == pytest.approx(4 / 3)
    assert records.sampled_pair_distance(old, "euclidean") > 0
    assert records.sampled_pair_distance(old.where("id = 1"), "euclidean") == 0
