"""Language ID, token packing, fingerprints of paragraphs, chats and archives."""

import io
import random
import struct
from itertools import product

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veldspar.llm import bitpack, chat, fingerprint, langid, warc
from veldspar.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.01"


# --- language ID ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs, sample_docs=60, keep_words=3000, keep_grams=4000)


def force_score(model, text):
    """Words one at a time, straight from the definition."""
    words = langid.LETTERS.findall(text.lower())
    total = np.zeros(len(model.languages))
    for w in words:
        if w in model.words:
            total += model.words[w]
            continue
        padded = f"^{w}$"
        for n in langid.ORDERS:
            known = [model.grams[padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in model.grams]
            if known:
                total += np.mean(known, axis=0)
                break
    mean = total / len(words)
    best = sorted(range(len(mean)), key=lambda i: (-round(mean[i], 9), i))
    return model.languages[best[0]], mean[best[0]] - mean[best[1]]


def test_held_out_accuracy_and_brute_force(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    rows = docs.collect()
    right = sum(got[r.doc_id].language == r.lang for r in rows)
    assert len(got) == len(rows) and right >= 0.97 * len(rows)
    assert sum(got[r.doc_id].keep for r in rows) >= 0.99 * len(rows)
    for r in rows[:150]:
        language, margin = force_score(model, r.text)
        assert got[r.doc_id].language == language and got[r.doc_id].margin == pytest.approx(margin, abs=1e-4)


def test_backoff_takes_the_longest_known_order():
    m = langid.fit({"a": {"kala": 5, "kalat": 2}, "b": {"mono": 5}})
    assert m.words.keys() == {"kala", "kalat", "mono"}
    unseen = m.word("kalas")
    assert np.allclose(unseen, np.mean([m.grams[g] for g in ("^kala",)], axis=0))
    assert np.allclose(m.word("zzoz"), np.mean([m.grams[g] for g in "^o$"], axis=0)) and np.allclose(m.word("xyz"), np.mean([m.grams[g] for g in "^$"], axis=0))
    assert m.score("Kala kalat")[0] == "a" and m.score("mono MONO")[0] == "b"


def test_odd_texts(odd, empty, model):
    rows = {(r.doc_id, r.words): r for r in langid.identify(odd, model).collect()}
    assert len(langid.identify(odd, model).collect()) == odd.count()
    for key in ((400, 0), (402, 0), (500, 0)):
        assert rows[key].language is None and rows[key].margin == 0 and rows[key].keep is False
    assert langid.identify(empty, model).count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id IN (400, 402, 500)").count() == 0 and kept.where("doc_id = 5").count() == 3
    none = langid.train(empty)
    assert none.languages == [] and none.score("word") == (None, 0.0, 1) and langid.keep_identified(odd, none).count() == 0
    one = langid.fit({"en": {"the": 1}})
    assert one.score("the")[0] == "en" and one.score("the")[1] == float("inf")


def test_sample_is_bounded_and_by_id(spark, odd):
    a, b = langid.train(odd, sample_docs=5), langid.train(odd.repartition(3), sample_docs=5)
    assert a.words.keys() == b.words.keys() and 0 < len(a.words) < len(langid.train(odd, sample_docs=50).words)


# --- token packing ---------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 11, 15, 16, 17, 24, 31, 32])
def test_packing_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 100, 257):
        ids = rng.integers(0, 1 << width, n)
        data, offsets = bitpack.pack(ids, width, 100)
        assert bitpack.unpack(data, offsets, n, width, 100).tolist() == ids.tolist()
        assert len(data) == sum(-(-min(100, n - i) * width // 8) for i in range(0, n, 100)) == offsets[-1]
        for i in range(n):
            assert bitpack.token_at(data, offsets, i, width, 100) == ids[i]
        if n > 100:
            assert bitpack.unpack_block(data[offsets[1] : offsets[2]], min(100, n - 100), width).tolist() == ids[100:200].tolist()


def test_packing_is_checked():
    assert [bitpack.width_of(v) for v in (1, 2, 3, 256, 257, 32_000, 50_257, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 17]
    for bad in ([8], [-1]):
        with pytest.raises(ValueError):
            bitpack.pack(bad, 3)
    with pytest.raises(ValueError):
        bitpack.width_of(0)


def test_tokens_round_trip(odd, empty, corpus):
    packed = bitpack.packed_tokens(odd, block=64)
    enc = bitpack.encoder(bitpack.TOKENIZER)
    rows = {r.doc_id: r for r in packed.collect() if r.doc_id is not None}
    for i, text in corpus:
        r = rows[i]
        ids = bitpack.unpack(bytes(r.packed), r.offsets, r.n_tokens, r.width, r.block)
        assert enc.decode(ids.tolist()) == text and r.width == 16
        assert not text or len(text) > 10_000 or ids.tolist() == enc.encode_ordinary(text)
    assert rows[500].packed is None and rows[500].n_tokens is None and rows[400].offsets == [0] and rows[400].packed == b""
    assert packed.count() == odd.count() and bitpack.packed_tokens(empty).count() == 0
    back = {r.doc_id: r.tokens for r in bitpack.unpacked_tokens(packed.where("doc_id < 10")).collect()}
    assert enc.decode(back[3]) == dict(corpus)[3]


def naive_pack(ids, width, block):
    """Bit by bit, from the definition."""
    out, offsets = bytearray(), [0]
    for at in range(0, len(ids), block):
        number = sum(int(i) << width * n for n, i in enumerate(ids[at : at + block]))
        out += number.to_bytes(-(-len(ids[at : at + block]) * width // 8), "little")
        offsets.append(len(out))
    return bytes(out), offsets


@pytest.mark.parametrize("vocabulary", [bitpack.VOCABULARY, 70_001, 200_000])
def test_packed_bytes_against_a_naive_packer(odd, corpus, vocabulary):
    """With 16 bits as production has them, and with 17 and 18."""
    width, enc = bitpack.width_of(vocabulary), bitpack.encoder(bitpack.TOKENIZER)
    rows = {r.doc_id: r for r in bitpack.packed_tokens(odd, vocabulary=vocabulary, block=100).where("doc_id IS NOT NULL").collect()}
    for i, text in corpus:
        if len(text) < 5000:
            ids, r = enc.encode_ordinary(text), rows[i]
            assert (bytes(r.packed), r.offsets) == naive_pack(ids, width, 100) and (r.n_tokens, r.width) == (len(ids), width)


def test_the_query_against_a_naive_packer(spark, tmp_path, corpus):
    from veldspar.llm.queries import QUERIES

    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = bitpack.encoder(bitpack.TOKENIZER)
    rows = {r.doc_id: r for r in QUERIES["op2_token_bitpack"](spark, str(tmp_path)).collect()}
    assert rows.keys() == dict(corpus).keys()
    for i, text in corpus:
        if len(text) < 100_000:
            ids = enc.encode_ordinary(text)
            assert (bytes(rows[i].packed), rows[i].offsets) == naive_pack(ids, 16, bitpack.BLOCK) and rows[i].n_tokens == len(ids)


def test_long_texts_are_encoded_alike_in_pieces(corpus):
    text = "\n".join(t for _, t in corpus[:40]) + "  two  spaces 12 3a"
    enc = bitpack.encoder(bitpack.TOKENIZER)
    parts = list(bitpack.pieces(text, 500))
    assert len(parts) > 20 and "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(bitpack.pieces("x" * 50, 10)) == ["x" * 50] and list(bitpack.pieces("", 10)) == [""]


# --- paragraph fingerprints -----------------------------------------------------------------


def test_multiset_homomorphism():
    rng = random.Random(0)
    parts = [rng.randbytes(rng.randint(1, 40)) for _ in range(30)]
    whole = fingerprint.fingerprint(parts)
    assert whole == fingerprint.fingerprint(reversed(parts)) and len(whole) == 8 * fingerprint.LANES
    assert whole != fingerprint.fingerprint(parts[1:]) and whole != fingerprint.fingerprint([*parts, parts[0]])
    assert fingerprint.inserted(fingerprint.fingerprint(parts[:10]), parts[10:]) == whole
    assert fingerprint.deleted(whole, parts[10:]) == fingerprint.fingerprint(parts[:10])
    assert fingerprint.deleted(whole, parts) == fingerprint.ZERO == fingerprint.fingerprint([])
    assert fingerprint.combined([fingerprint.fingerprint(parts[:3]), fingerprint.fingerprint(parts[3:])]) == whole


def test_fingerprints_of_documents(spark, odd, empty):
    rows = [(1, "b\na\n\n a "), (2, "a\nb\na"), (3, "a\nb"), (4, ""), (5, None), (6, " \n"), (None, "a\nb")]
    got = {r.doc_id: (r.paragraphs, r.fingerprint) for r in fingerprint.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[1][0] == 3 and got[3] != got[2] and got[3] == got[None]
    assert got[4] == got[6] == (0, fingerprint.ZERO) and got[5] == (None, None)
    assert fingerprint.document_fingerprints(odd).count() == odd.count() and fingerprint.document_fingerprints(empty).count() == 0


def test_fingerprint_sql(spark, tmp_path):
    rows = [(1, "b\na\n\n a "), (2, "é\n\nü"), (4, ""), (5, None), (6, " \n"), (None, "a\nb"), (1, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "d"))
    sql = duckdb.sql(ORACLE_SQL["op6_multiset_hash"].replace("FROM documents", f"FROM '{tmp_path}/d/*.parquet'")).fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in fingerprint.document_fingerprints(frame).collect())


# --- chats -----------------------------------------------------------------------------------


def force_cost(roles):
    """The least cost over all edits, tried one by one, with up to two insertions in a row."""
    best = [10**9]

    def go(i, last, cost, inserted):
        if cost >= best[0]:
            return
        if i == len(roles) and last in chat.FINAL:
            best[0] = cost
        for role in chat.NEXT[last]:
            if inserted < 3:
                go(i, role, cost + chat.INSERT, inserted + 1)
            if i < len(roles):
                go(i + 1, role, cost + chat.role_cost(roles[i], role), 0)
        if i < len(roles) and last != chat.START:
            go(i + 1, last, cost + chat.MERGE + chat.role_cost(roles[i], last), 0)

    go(0, chat.START, 0, 0)
    return best[0]


def legal(roles):
    last = chat.START
    for r in roles:
        if r not in chat.NEXT[last]:
            return False
        last = r
    return last in chat.FINAL


def test_repairs_are_cheapest_and_legal():
    names = ("system", "user", "assistant", "tool", None)
    for n in range(1, 5):
        for roles in product(names, repeat=n):
            cost, turns = chat.repair(roles)
            assert cost == force_cost(roles), roles
            assert legal([r for r, _ in turns]) and [i for _, m in turns for i in m] == list(range(n))
            price = sum(chat.INSERT if not m else sum(chat.role_cost(roles[i], r) for i in m) + chat.MERGE * (len(m) - 1) for r, m in turns)
            assert price == cost
    for roles in (("user", "assistant"), ("system", "user", "assistant", "user", "assistant")):
        assert chat.repair(roles) == (0, tuple((r, (i,)) for i, r in enumerate(roles)))
    assert chat.repair(()) == (0, ())


def test_chats_of_a_table(spark):
    rows = [
        (1, 1, "assistant", "hi", 0), (1, 0, "user", "q <|end|>", 0), (2, 0, " User ", "a", 0), (2, 0, "user", "b", 0), (2, 1, "bot", None, 0),
        (3, 0, None, None, 0), (None, 0, "user", "x", 0), (4, None, "assistant", "last", 0), (4, 5, "user", "first", 0), (5, 0, "user", "r", 0), (5, 0, "user", "r", 0), (5, 1, "assistant", "s", 0),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, given int")
    got = {r.conv_id: r for r in chat.formatted_chats(frame.withColumn("plan", frame.text)).collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    assert got[1].chat == "<|user|>\nq <\\|end|><|end|>\n<|assistant|>\nhi<|end|>\n" and got[1].cost == 0 and got[1].n_turns == 2
    assert got[2].roles == "user,assistant" and got[2].cost == chat.MERGE + chat.NAME and "<|user|>\na\nb<|end|>" in got[2].chat
    assert got[3].roles == "user,assistant" and got[3].cost == chat.INSERT + chat.NAME
    assert got[4].chat.index("first") < got[4].chat.index("last") and "r\nr" in got[5].chat
    assert chat.formatted_chats(frame.where("false")).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, i, random.Random(i).choice(["user", "assistant", "system", "x"]), "t" * 50) for i in range(3000)]
    r = chat.formatted_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert legal(r.roles.split(",")) and r.chat.count("t" * 50) == 3000


def test_repairs_remembered_are_short(spark):
    rng = random.Random(3)
    long = tuple(rng.choice(chat.ROLES) for _ in range(500))
    before = chat._remembered.cache_info().currsize
    cost, turns = chat.repair(long)
    assert chat._remembered.cache_info().currsize == before and cost >= 0 and [i for _, m in turns for i in m] == list(range(500))
    merged = chat.repair(("user",) * 20_000 + ("assistant",))
    assert [i for _, m in merged[1] for i in m] == list(range(20_001)) and legal([r for r, _ in merged[1]])
    assert chat.repair(long[:20]) is chat.repair(long[:20])


def test_a_very_long_turn(spark):
    rows = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "<|" * 10)]
    r = chat.formatted_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.chat.count("x") == 3_000_000 and r.cost == 0 and "<\\|" * 10 in r.chat


# --- archives -----------------------------------------------------------------------------------


def test_pages_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(200))) for i in range(80)]
    rows += [(None, "http://n", "a"), (81, None, "b"), (82, "u", None), (83, "", ""), (84, "u2", "é" * 300_000), rows[3], rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = warc.archived_pages(pages, f"file://{tmp_path}/a").collect()
    assert sorted(map(str, got)) == sorted(str(warc_row) for warc_row in (type(got[0])(page_id=a, url=b, html=c, error=None) for a, b, c in rows))
    assert all(open(p, "rb").read(4) == struct.pack("<I", warc.MAGIC_DICTIONARY) for p in tmp_path.glob("a/*.warc.zst"))
    assert warc.archived_pages(pages.where("false"), f"file://{tmp_path}/none").count() == 0


def packed(*records, dictionary=None, compressed=True):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=d) if d else zstandard.ZstdCompressor()
    return (warc.dictionary_frame(dictionary, compressed) if dictionary else b"") + b"".join(c.compress(r) for r in records)


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("read", [1, 13, 1 << 20])
def test_frames_and_dictionary(compressed, read):
    samples = [b"<html><body>page %d of many pages that look alike</body></html>" % i * 3 for i in range(500)]
    dictionary = warc.train_dictionary(samples, 2000)
    records = [warc.record("resource", f"<urn:{i}>", s) for i, s in enumerate(samples[:20])]
    data = packed(*records, dictionary=dictionary, compressed=compressed)
    found = list(warc.frames(io.BytesIO(data), read=read))
    assert [f[1] for f in found] == records and all(f[2] is None for f in found)
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for (position, *_), r in zip(found, records):
        assert data[position : position + 4] == warc.MAGIC_FRAME and data[position:].startswith(c.compress(r))
    extra = data + struct.pack("<II", 0x184D2A51, 3) + b"abc" + zstandard.ZstdCompressor().compress(records[0])
    assert len(list(warc.frames(io.BytesIO(extra), read=read))) == 21
    assert list(warc.frames(io.BytesIO(data[: len(data) - 5]), read=read))[-1][2] == "the file ends within a frame"


def test_broken_files():
    assert list(warc.frames(io.BytesIO(b""))) == []
    assert "can't be decompressed" in list(warc.frames(io.BytesIO(b"not a frame at all")))[-1][2]
    assert list(warc.frames(io.BytesIO(b"\x28\xb5")))[-1][2] == "the file ends within a frame's head"
    assert list(warc.frames(io.BytesIO(struct.pack("<II", warc.MAGIC_DICTIONARY, 99) + b"x")))[-1][2] == "the file ends within a skippable frame"
    assert "dictionary" in list(warc.frames(io.BytesIO(struct.pack("<II", warc.MAGIC_DICTIONARY, 12) + warc.MAGIC_FRAME + b"\xff" * 8)))[-1][2]
    big = packed(warc.record("resource", "<a>", b"z" * 5000))
    assert "more than 1000" in list(warc.frames(io.BytesIO(big), limit=1000))[-1][2]


def test_records_after_a_large_one_are_read():
    small = [warc.record("resource", f"<{i}>", b"s%d" % i) for i in range(3)]
    large = warc.record("resource", "<a>", bytes(range(256)) * 40)
    data = packed(small[0], large, small[1], large, small[2])
    for read in (1, 100, 1 << 20):
        found = list(warc.frames(io.BytesIO(data), read=read, limit=1000))
        assert [f[1] for f in found] == [small[0], None, small[1], None, small[2]]
        assert [f[2] for f in found] == [None, "a record of more than 1000 bytes"] * 2 + [None]
        whole = list(warc.frames(io.BytesIO(data), read=read))
        assert [f[0] for f in whole] == [f[0] for f in found] and whole[1][1] == large


def test_urls_come_back_as_they_were(spark, tmp_path):
    urls = [" http://a/ ", "http://a/b c", "x\r\ny", "\n", "  ", "", None, 'q"\\é', "\tt", "%0A"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("h"))
    got = {r.page_id: (r.url, r.error) for r in warc.archived_pages(pages, f"file://{tmp_path}/u").collect()}
    assert got == {i: (u, None) for i, u in enumerate(urls)}


def test_the_dictionary_learns_from_all_parts_of_pages(spark, tmp_path):
    """Of pages far longer than a piece, pieces anywhere are chosen; rows don't depend on it."""
    rng = random.Random(6)
    pages = [(i, f"u{i}", "".join(f"<p class='{rng.choice('abc')}'>{rng.random()}</p>" for _ in range(2000))) for i in range(4)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for pieces, chars in ((400, 1 << 18), (300, 500), (5, 1000)):
        path = f"{tmp_path}/d{pieces}-{chars}"
        assert warc.write_archives(frame, f"file://{path}", pieces, chars) == 4
        assert {bytes(r.payload).decode() for r in warc.read_archives(spark, f"file://{path}").collect()} == {h for *_, h in pages}


@pytest.mark.parametrize("uri", ["file:/a/b", "file:///a/b", "/a/b"])
def test_local_paths(uri):
    assert warc.filesystem(uri)[1] == "/a/b" and warc.SCHEMES["s3a"] == "s3"


def test_records_are_validated():
    good = warc.record("resource", "<urn:1>", b"body", **{"WARC-Target-URI": "http://a"})
    headers, payload, error = warc.parse(good)
    assert payload == b"body" and error is None and headers["warc-target-uri"] == "http://a"
    wrong = {
        b"HTTP/1.1\r\n\r\n": "no WARC version line",
        b"WARC/1.1\r\nA: b": "headers don't end",
        good.replace(b"WARC-Type", b"X-Type"): "no warc-type",
        good.replace(b"Length: 4", b"Length: four"): "content-length is no number",
        good.replace(b"Length: 4", b"Length: 9"): "content-length is 9, 4 bytes are there",
        good[:-2]: "content-length is 4, 2 bytes are there",
        good[:-4] + b"abcd": "the record doesn't end in two line breaks",
        good.replace(b"WARC-Date: ", b"WARC-Date "): "a malformed header",
        good.replace(b"WARC-Date", b"WARC-Block-Digest: sha256:00\r\nWARC-Date"): "the block digest differs",
    }
    for data, message in wrong.items():
        assert warc.parse(data)[2] == message
    assert warc.parse(good.replace(b"http://a", b"http://a\r\n b"))[0]["warc-target-uri"] == "http://a b"


def test_bad_records_are_rows(spark, tmp_path):
    good = warc.record("resource", "<urn:1>", b"body")
    (tmp_path / "x.warc.zst").write_bytes(packed(good, good.replace(b"Length: 4", b"Length: 5"), good) + b"rubbish!!")
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    rows = warc.read_archives(spark, f"file://{tmp_path}").orderBy("position").collect()
    assert [bytes(r.payload) if r.payload is not None else None for r in rows] == [b"body", None, b"body", None]
    assert [bool(r.error) for r in rows] == [False, True, False, True] and rows[1].record_id == "<urn:1>"
    assert warc.read_archives(spark, f"file://{tmp_path}/x.warc.zst").count() == 4
