"""Requests over HTTP, span files, and loads of files."""

import gzip
import io
import json
import struct
import threading
import urllib.error
import urllib.request
import zlib

import numpy as np
import pytest

from veldspar import service
from veldspar.cli import main
from veldspar.engine import Engine
from veldspar.functions import quantization
from veldspar.sources import exchange, spans

ROOT = "/api/v1/collections"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("service")))


def ask(engine, method, path="", body=None):
    return service.handle(engine, method, ROOT + path, b"" if body is None else json.dumps(body).encode())


def test_life_of_a_collection(engine):
    assert ask(engine, "POST", "", {"name": "c", "vector_size": 5, "quantization": 64, "distance_function": "cosine"})[0] == 201
    for bad in ({"name": "c", "vector_size": 5, "distance_function": "cosine"}, {"name": "d", "vector_size": 5, "distance_function": "dot"}, {"name": "d"}, [], {"name": "d", "vector_size": 3, "quantization": 12, "distance_function": "cosine"}):
        assert ask(engine, "POST", "", bad)[0] == 400
    assert service.handle(engine, "POST", ROOT, b"{")[0] == 400
    rows = [{"id": i, "vector": [i * x for x in (0.1, 0.2, 0.3, 0.4, 0.5)], "metadata": {"id": i, "kind": "AB"[i % 2]}} for i in range(10)]
    assert ask(engine, "POST", "/c/records", rows)[0] == 201
    for bad in ([{"id": 1, "metadata": {}}], [{"vector": [1]}], {"id": 1}, [{"id": 1, "vector": [1, 2]}]):
        assert ask(engine, "POST", "/c/records", bad)[0] == 400
    status, found = ask(engine, "GET")
    assert status == 200 and [(r["name"], r["document_count"], r["distance_method"]) for r in found] == [("c", 10, "cosine")]
    assert ask(engine, "GET", "/c")[1]["dimension_count"] == 5 and ask(engine, "GET", "/c/ids") == (200, list(range(10)))
    for limit, offset, wanted in ((3, 0, [0, 1, 2]), (3, 9, [9]), (20, 0, list(range(10))), (3, 20, [])):
        assert [r["id"] for r in ask(engine, "GET", f"/c/search?limit={limit}&offset={offset}")[1]["results"]] == wanted
    status, found = ask(engine, "POST", "/c/search", {"vector": rows[3]["vector"], "k": 3, "filter": "kind == 'A' AND id > 0"})
    assert status == 200 and len(found["results"]) == 3 and found["percent_searched"] == 100 and found["results"][0]["metadata"]["kind"] == "A"
    assert {"results", "percent_searched", "search_time", "embedding_time"} == found.keys()
    for bad in ({"vector": [1], "k": 1}, {"k": "x"}, {"filter": "a ==="}, {"vector": "abc", "k": 1}):
        assert ask(engine, "POST", "/c/search", bad)[0] == 400
    assert ask(engine, "PUT", "/c/records/3/metadata", {"metadata": {"kind": "new"}})[1]["id"] == 3
    assert [r["id"] for r in ask(engine, "GET", "/c/search?filter=kind%20%3D%3D%20%27new%27")[1]["results"]] == [3]
    assert ask(engine, "DELETE", "/c/records/3")[0] == 200
    for path, method in (("/c/records/3", "DELETE"), ("/c/records/3/metadata", "PUT"), ("/none", "GET"), ("/none/search", "GET")):
        assert ask(engine, method, path, {})[0] == 404
    assert ask(engine, "DELETE", "/c/records/x")[0] == 400 and ask(engine, "POST", "/c/ids")[0] == 405 and service.handle(engine, "GET", "/other")[0] == 404
    assert ask(engine, "DELETE", "/c")[0] == ask(engine, "DELETE", "/c")[0] == 200 and ask(engine, "GET") == (200, [])


def test_the_server(engine):
    server = service.server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}{ROOT}"
    send = lambda method, path, body=None, **headers: urllib.request.urlopen(urllib.request.Request(url + path, None if body is None else json.dumps(body).encode(), headers, method=method), timeout=60)
    assert send("POST", "", {"name": "s", "vector_size": 2, "distance_function": "euclidean"}).status == 201
    send("POST", "/s/records", [{"id": i, "vector": [i, 1], "metadata": {"n": i}} for i in range(60)])
    assert [r["id"] for r in json.load(send("POST", "/s/search", {"vector": [7, 1], "k": 1}))["results"]] == [7]
    packed = send("GET", "/s/search", **{"Accept-Encoding": "gzip"})
    assert packed.headers["Content-Encoding"] == "gzip" and len(json.loads(gzip.decompress(packed.read()))["results"]) == 60
    with pytest.raises(urllib.error.HTTPError) as refused:
        send("GET", "/none")
    assert refused.value.code == 404 and "error" in json.load(refused.value)
    send("DELETE", "/s")
    server.shutdown()


# --- span files ------------------------------------------------------------------------


def test_varints():
    for n in (0, 1, 0x7E, 0x7F, 0x80, 0x3FFF, 0x4000, 2**35, 2**63):
        data = spans.write_varint(n)
        assert spans.read_varint(data, 0) == (n, len(data)) and all(b & 0x80 for b in data[:-1])
    assert spans.write_varint(300) == b"\x82\x2c"
    assert spans.read_varint(b"\x80\x05", 0) == (5, 2)  # a longer form than needed
    with pytest.raises(ValueError):
        spans.read_varint(b"\x82", 0)


def test_spans():
    span = spans.write_span("17", {0: b"meta", 1: b"\x00\x01"}, 300, padding=3)
    assert struct.unpack(">II", span[:8]) == (0x5350414E, len(span)) and struct.unpack(">I", span[-4:])[0] == zlib.crc32(span[:-4])
    assert spans.read_span(span) == ("17", 300, {0: b"meta", 1: b"\x00\x01"})
    broken = span[:12] + b"\xff" + span[13:]
    free = spans.write_span("9", {}, 1, padding=20, magic=spans.FREE)
    found = list(spans.spans(io.BytesIO(span + free + broken + span + bytes(50))))
    assert [p for p, *_ in found] == [0, len(span + free), len(span + free + broken)]
    assert [bool(e) for *_, e in found] == [False, True, False]
    assert list(spans.spans(io.BytesIO(span[:-2])))[-1][2] == "the file ends within the span"
    assert list(spans.spans(io.BytesIO(span + b"rubbish here")))[-1][2] == "no span begins here" and list(spans.spans(io.BytesIO(b""))) == []


@pytest.mark.parametrize("bits", quantization.BITS)
def test_import_of_a_span_file(spark, tmp_path, capsys, bits):
    rng = np.random.default_rng(bits)
    vectors = rng.uniform(-1, 1, (6, 5))
    top = (1 << bits) - 1
    codes = [((v + 1) / 2 * top + 0.5).astype(int) if bits <= 16 else v for v in vectors]
    header = {"name": "old.dat", "distance_method": 1, "dimension_count": 5, "quantization": bits}
    data = spans.write_span("", {0: json.dumps(header).encode()}, 1)
    for i, c in enumerate(codes):
        data += spans.write_span(str(i), {0: b'{"n":%d}' % i, 1: quantization.pack(c, bits)}, 2 + i)
    data += spans.write_span("2", {0: b"later", 1: quantization.pack(codes[0], bits)}, 50)
    data += spans.write_span("3", {}, 40, padding=30, magic=spans.FREE) + bytes(100)
    (tmp_path / "old.dat").write_bytes(data)
    main(["--data-folder", str(tmp_path / "d"), "--import-spans", str(tmp_path / "old.dat"), "--name", "new"], spark)
    c = Engine(spark, str(tmp_path / "d")).collection("new")
    got = {r.id: r for r in c.frame().collect()}
    assert c.options.distance_method == "cosine" and c.options.quantization == bits and sorted(got) == list(range(6))
    stored = [np.array(x) / top * 2 - 1 if bits <= 16 else np.float32(x) if bits == 32 else x for x in codes]
    assert got[2].metadata == "later" and np.allclose(got[2].vector, stored[0]) and all(np.allclose(got[i].vector, stored[i]) for i in (0, 1, 3, 4, 5))
    assert got[4].metadata == '{"n":4}'
    (tmp_path / "bad.dat").write_bytes(data[30:])
    with pytest.raises(ValueError):
        spans.import_spans(spark, str(tmp_path / "d"), "bad", str(tmp_path / "bad.dat"))


# --- files --------------------------------------------------------------------------------


def test_exports_are_read_in_parallel(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"))
    c = engine.create_collection("e", 2, 32)
    c.upsert([(10, [1, 2], {"name": "ten, \n{}", "n": [1, None]}), (9, [0.5, 6], None), (2, [9, 10], {"]}": ","})])
    with open(tmp_path / "e.json", "w") as out:
        exchange.export_json(c, out)
    same = lambda x: sorted((r.id, r.vector, json.loads(r.metadata or "null")) for r in x.frame().collect())
    assert same(exchange.import_file(spark, str(tmp_path / "d"), "a", str(tmp_path / "e.json"))) == same(c)
    whole = json.loads((tmp_path / "e.json").read_text())
    (tmp_path / "other.json").write_text(json.dumps(whole, indent=1))
    assert same(exchange.import_file(spark, str(tmp_path / "d"), "b", str(tmp_path / "other.json"))) == same(c)
    main(["--data-folder", str(tmp_path / "d"), "--export", "e", "--folder", "--output", str(tmp_path / "f")], spark)
    main(["--data-folder", str(tmp_path / "d"), "--import", str(tmp_path / "f"), "--folder", "--name", "g"], spark)
    assert same(engine.collection("g")) == same(c)


def test_csv_loads_go_on(spark, tmp_path):
    lines = [f'{i},"text {i}"' if i % 7 else f"{i}," for i in range(100)]
    (tmp_path / "t.csv").write_text("\n".join(lines[:40]) + "\n")
    c = Engine(spark, str(tmp_path / "d")).create_collection("csv", 8)
    assert exchange.load_csv(c, str(tmp_path / "t.csv"), 1, resume=True) == 34
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    assert exchange.load_csv(c, str(tmp_path / "t.csv"), 1, {"t": 1}, resume=True, multi_line=False) == 51
    got = {r.id: json.loads(r.metadata) for r in c.frame().collect()}
    texts = [f"text {i}" for i in range(100) if i % 7]
    assert [next(iter(got[i].values())) for i in range(85)] == texts and len(got) == 85 and "t" in got[84]
    assert exchange.load_csv(c, str(tmp_path / "t.csv"), 1, resume=True) == 0 and exchange.load_csv(c, str(tmp_path / "t.csv"), 1) == 85
    assert sorted(r.id for r in c.ids().collect()) == list(range(170))
