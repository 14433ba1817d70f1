"""SimHash with Golay keys, and components, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from veldspar.llm import components, simhash


def groups_by_force(prints, limit):
    """Smallest member of the group of every doc that is in one."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bits = {i: int.from_bytes(f, "big") for i, f in prints.items()}
    for a, b in combinations(sorted(prints), 2):
        if (bits[a] ^ bits[b]).bit_count() <= limit:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = {i: find(i) for i in prints}
    roots = [r for i, r in found.items() if i != r]
    return {i: r for i, r in found.items() if r in roots}


def test_code_is_perfect_and_keys_meet():
    assert np.bincount(simhash._COUNT).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    for a, b in [(i, j) for i in range(0, 23, 4) for j in range(23)]:
        w = v ^ np.uint32(1 << a) ^ np.uint32(1 << b if a != b else 0)
        (ka, ta), (kb, tb) = simhash.segment_keys(v), simhash.segment_keys(w)
        assert ((ka[:, :, None] == kb[:, None, :]) & ta[:, :, None] & tb[:, None, :]).any(axis=(1, 2)).all()


def test_codewords_are_their_own_key():
    for info in (0, 1, 77, 4095):
        word = next(w for w in range(info << 11, (info + 1) << 11) if simhash._remainder(w) == 0)
        keys, taken = simhash.segment_keys(np.array([word]))
        assert keys[0][taken[0]].tolist() == [info]


def test_distance_guaranteed_by_pigeonhole():
    rng = random.Random(5)
    base = np.frombuffer(rng.randbytes(simhash._BYTES), np.uint8).copy()
    base[-1] &= 0xFC
    for _ in range(300):
        other = np.unpackbits(base)
        other[rng.sample(range(simhash.BITS), 14)] ^= 1
        pair = np.stack([base, np.packbits(other)])
        bucket, owner = simhash.buckets(pair)
        keys, rows = simhash.full_keys(bucket, pair[owner])
        mine, theirs = (set(keys[owner[rows] == i].tolist()) for i in (0, 1))
        assert mine & theirs


@pytest.mark.parametrize("split", [0, 2, 5])
def test_split_buckets_have_the_same_keys(split):
    fps = np.random.default_rng(1).integers(0, 256, (50, simhash._BYTES)).astype(np.uint8)
    fps[:, -1] &= 0xFC
    found = []
    for s in (0, split):
        bucket, owner = simhash.buckets(fps, s)
        keys, rows = simhash.full_keys(bucket, fps[owner], s)
        found.append(sorted(zip(keys.tolist(), owner[rows].tolist())))
    assert found[0] == found[1] and len(set(found[0])) == len(found[0])


@pytest.mark.parametrize("wide", [2, 256])
def test_pairs_of_large_and_small_keys_connect_the_same(monkeypatch, wide):
    monkeypatch.setattr(simhash, "_WIDE", wide)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (20, 4)).astype(np.uint64)
    fps = np.repeat(centres, 8, axis=0)
    fps[:, 0] ^= (1 << rng.integers(0, 60, 160)).astype(np.uint64)
    keys = rng.integers(0, 6, 160).astype(np.uint64)
    a, b = simhash.near_pairs(keys, np.arange(160), fps, 2)
    got = simhash._labels(160, a, b)
    x, y = np.array([(i, j) for i, j in combinations(range(160), 2) if keys[i] == keys[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 2]).T
    assert got.tolist() == simhash._labels(160, x, y).tolist()


def links_by_force(prints, groups, limit):
    bits = {i: int.from_bytes(prints[i], "big") for i in groups}
    return {i: sum(groups[i] == groups[o] and i != o and (bits[i] ^ bits[o]).bit_count() <= limit for o in groups) for i in groups}


@pytest.mark.parametrize("block", [simhash.LINK_BLOCK, 2])
def test_near_duplicates_against_brute_force(corpus, odd, monkeypatch, block):
    monkeypatch.setattr(simhash, "LINK_BLOCK", block)
    rows = simhash.near_duplicates(odd).collect()
    got = {r.doc_id: r.keep_id for r in rows}
    prints = {i: f for i, t in corpus if (f := simhash.fingerprint(t)) is not None}
    wanted = groups_by_force(prints, simhash.MAX_DISTANCE)
    assert got == wanted and len(rows) == len(got)
    assert {r.doc_id: r.links for r in rows} == links_by_force(prints, wanted, simhash.MAX_DISTANCE)
    for i in range(10):
        assert got[i] == got[100 + i] == i and got[20 + i] == got[200 + i] == 20 + i
    assert got[401] == got[403] == 401 and 400 not in got and 402 not in got and not {300, 301, 404, 405, 406} & got.keys()


def test_links_of_a_large_group(spark, monkeypatch):
    """Copies of a text, some of them changed a little: blocks of any size count the same."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        changed = list(words)
        for _ in range(i % 4 * 4):
            changed[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(changed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    groups = groups_by_force(prints, simhash.MAX_DISTANCE)
    wanted = links_by_force(prints, groups, simhash.MAX_DISTANCE)
    assert len(set(wanted.values())) > 2
    for block in (4096, 13, 5):
        monkeypatch.setattr(simhash, "LINK_BLOCK", block)
        assert {r.doc_id: (r.keep_id, r.links) for r in simhash.near_duplicates(docs).collect()} == {i: (groups[i], wanted[i]) for i in groups}


def test_filter_keeps_one_of_each_group(odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").where("doc_id IS NOT NULL").collect())
    assert not set(ids) & set(range(100, 110)) and set(range(60)) <= set(ids) and {400, 401, 402, 500} <= set(ids) and 403 not in ids
    assert ids.count(5) == 3 and kept.where("doc_id IS NULL").count() == 2


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    rng, n = random.Random(3), 200
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(60, n), rng.randrange(60, n)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = simhash._labels(n, *np.array(edges).T)
    assert got == {i: int(label[i]) for i in range(n) if label[i] != i}
