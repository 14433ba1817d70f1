"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A document's fingerprint has 230 bits: each distinct word votes on each bit. It is
cut into ten segments of 23 bits. The binary Golay code of length 23 is perfect:
every 23-bit word lies within distance 3 of exactly one codeword. A segment's keys
are the 12-bit indices of all codewords within distance 4 of it: one or six. Of
any two segments at distance two at most, the word halfway between them decodes to
a codeword within distance 3 of it, so within 4 of both: they share a key.

Two segments make a band, and a key of a band is a pair of their keys (24 bits).
By the pigeonhole principle, fingerprints that differ in at most 14 bits have a
band without a segment of three errors or more, so share a key; of those that
differ in more, up to ``max_distance``, nearly all do. All pairs that share a key
are verified on the whole fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, WORD, column_values, keyed_texts, materialise, partitions
from .components import components

SEGMENT, SEGMENTS = 23, 10
BITS = SEGMENT * SEGMENTS
BANDS = SEGMENTS // 2
_BYTES = (BITS + 7) // 8
_WORDS = (_BYTES + 7) // 8

#: Fingerprints that differ in so many bits at most belong together.
MAX_DISTANCE = 28

#: A run of characters this long is no word of a spaced script; it counts by character 5-grams.
_LONG = 40

# --- the code ---------------------------------------------------------------

_GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for shift in range(22, 10, -1):
        if v >> shift & 1:
            v ^= _GENERATOR << (shift - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = np.array([_remainder(v) for v in range(1 << 12)], np.uint32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.uint32)
    errors, count = np.zeros((1 << 11, 6), np.uint32), np.zeros(1 << 11, np.uint8)
    bit = [_remainder(1 << i) for i in range(SEGMENT)]
    for weight in range(5):
        for at in combinations(range(SEGMENT), weight):
            s = 0
            for i in at:
                s ^= bit[i]
            errors[s, count[s]] = sum(1 << i for i in at)
            count[s] += 1
    return low, high, errors, count


_LOW, _HIGH, _ERRORS, _COUNT = _tables()


def segment_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: the indices of the codewords within distance 4 (up to six),
    and which of the six places are taken."""
    v = v.astype(np.uint32)
    s = _LOW[v & 0xFFF] ^ _HIGH[v >> 12]
    return (v[..., None] ^ _ERRORS[s]) >> 11, np.arange(6) < _COUNT[s][..., None]


# --- fingerprints -----------------------------------------------------------


class _Votes:
    """Remembers each word's row of 0/1 votes, one byte a bit, eight to a uint64."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, _BYTES), np.uint64)

    def of(self, words: set[str]) -> np.ndarray:
        if len(self.index) + len(words) > max(REMEMBERED, len(words)):
            self.index.clear()
        index, ids = self.index, []
        for w in words:
            i = index.get(w)
            if i is None:
                i = index[w] = len(index)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                digest = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=_BYTES).digest()
                self.rows[i] = np.unpackbits(np.frombuffer(digest, np.uint8)).view(np.uint64)
            ids.append(i)
        return self.rows[ids]


def features(text: str) -> set[str]:
    """The distinct words that vote. A run of more than ``_LONG`` letters, as scripts without
    spaces have, counts by its character 5-grams."""
    found = set(WORD.findall(text.lower()))
    for w in [w for w in found if len(w) > _LONG]:
        found.discard(w)
        found.update(w[i : i + 5] for i in range(len(w) - 4))
    return found


def fingerprint(text: str, votes: _Votes | None = None) -> bytes | None:
    """BITS bits, padded with zeros to whole 64-bit words; None for a text without words. Words
    of more than ``_LONG`` (40) characters count by their 5-grams, see ``features``."""
    found = features(text)
    if not found:
        return None
    rows = (votes or _Votes()).of(found)
    # sums of up to 255 rows fit the bytes of a uint64
    sums = np.add.reduceat(rows, np.arange(0, len(rows), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    bits = np.zeros(_WORDS * 64, np.uint8)
    bits[:BITS] = (2 * sums > len(rows))[:BITS]
    return np.packbits(bits).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = _Votes()
    for batch in batches:
        ids, out = [], []
        for i, text in zip(*column_values(batch, "doc_id", "text")):
            if (f := fingerprint(text, votes)) is not None:
                ids.append(i)
                out.append(f)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp); rows without id or without any word have no fingerprint."""
    return keyed_texts(docs).mapInArrow(_fingerprints, "doc_id long, fp binary")


# --- keys, by part ----------------------------------------------------------


def segment_at(fps: np.ndarray, segment: int) -> np.ndarray:
    """One 23-bit segment of fingerprints given as rows of bytes."""
    first, last = segment * SEGMENT // 8, (segment * SEGMENT + SEGMENT - 1) // 8
    bits = np.unpackbits(fps[:, first : last + 1], axis=1)[:, segment * SEGMENT - 8 * first :][:, :SEGMENT]
    return bits.astype(np.uint32) @ (1 << np.arange(SEGMENT, dtype=np.uint32))


def buckets(fps: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints (rows of bytes): the buckets they are in, and whose each is.

    A bucket is a band, a key of the band's first segment, and the leading ``split``
    bits of one of the second. The keys of the second segment needn't travel: a bucket
    has the fingerprints, and they follow from these.
    """
    all_buckets, owners = [], []
    for band in range(BANDS):
        keys, taken = segment_keys(segment_at(fps, 2 * band))
        if split:
            second, also = segment_keys(segment_at(fps, 2 * band + 1))
            keys = (keys[:, :, None] << split | second[:, None, :] >> (12 - split)).reshape(len(fps), 36)
            taken = (taken[:, :, None] & also[:, None, :]).reshape(len(fps), 36)
        owner = np.nonzero(taken)[0]
        pairs = np.unique(np.stack([owner, keys[taken] | np.uint32(band << 12 + split)], axis=1), axis=0) if split else np.stack([owner, keys[taken] | np.uint32(band << 12)], axis=1)
        owners.append(pairs[:, 0])
        all_buckets.append(pairs[:, 1].astype(np.uint32))
    return np.concatenate(all_buckets), np.concatenate(owners)


def full_keys(bucket: np.ndarray, fps: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All (band, first key, second key) that rows of buckets have, and which row has each."""
    keys, rows = [], []
    for band in range(BANDS):
        here = np.flatnonzero(bucket >> 12 + split == band)
        if not len(here):
            continue
        second, taken = segment_keys(segment_at(fps[here], 2 * band + 1))
        if split:
            taken = taken & (second >> 12 - split == (bucket[here] & (1 << split) - 1)[:, None])
        at, which = np.nonzero(taken)
        keys.append((bucket[here][at].astype(np.uint64) >> np.uint64(split)) << np.uint64(12) | second[at, which].astype(np.uint64))
        rows.append(here[at])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


_CHUNK = 4096


def _emitter(parts: int, split: int):
    """Rows (part, buckets, ids, fps): what a chunk of fingerprints sends to a part, packed,
    so that the shuffle moves few large rows instead of many small ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                piece = batch.slice(at, _CHUNK)
                ids = np.array(piece.column(0).to_pylist(), np.int64)
                fps = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)[:, :_BYTES]
                bucket, owner = buckets(fps, split)
                part = (bucket * np.uint32(0x9E3779B1) >> np.uint32(8)) % np.uint32(parts)
                order = np.argsort(part, kind="stable")
                bucket, owner, part = bucket[order], owner[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                rows: list[tuple] = []
                for b, o, p in zip(np.split(bucket, cuts), np.split(owner, cuts), part[np.r_[0, cuts]] if len(part) else []):
                    rows.append((int(p), b.tobytes(), ids[o].tobytes(), fps[o].tobytes()))
                    if len(rows) >= 64:
                        yield _packed(rows)
                        rows = []
                if rows:
                    yield _packed(rows)

    return emit


_PACKED = ("part", "buckets", "ids", "fps")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], list(_PACKED))


# --- verification within a part ----------------------------------------------

_WIDE = 256


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint16) <= limit


def near_pairs(keys: np.ndarray, docs: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of docs (indices into fps) that share a key and differ in ``limit`` bits
    at most. Of a key with very many docs, pairs enough to connect all that such
    pairs connect: a doc that is linked already is not compared with the others
    that are, as that can't change a component."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for s, m in zip(starts[sizes > _WIDE], sizes[sizes > _WIDE]):
        pending = np.unique(docs[s : s + m])
        while len(pending):
            frontier, pending = [pending[0]], pending[1:]
            while frontier and len(pending):
                f = frontier.pop()
                hit = _near(fps[pending], fps[f], limit)
                if hit.any():
                    found, pending = pending[hit], pending[~hit]
                    left.append(np.full(len(found), f))
                    right.append(found)
                    frontier.extend(found)
    narrow = (sizes > 1) & (sizes <= _WIDE)
    keep = np.repeat(narrow, sizes)
    docs, left_over = docs[keep], np.repeat(sizes[narrow], sizes[narrow])
    rank = np.arange(len(docs)) - np.repeat(np.cumsum(sizes[narrow]) - sizes[narrow], sizes[narrow])
    for step in range(1, int(left_over.max(initial=1))):
        i = np.flatnonzero(rank + step < left_over)
        for at in range(0, len(i), 1 << 18):
            a, b = docs[i[at : at + (1 << 18)]], docs[i[at : at + (1 << 18)] + step]
            ok = _near(fps[a], fps[b], limit)
            left.append(a[ok])
            right.append(b[ok])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, m)
        np.minimum.at(now, b, m)
        np.minimum.at(now, label[a], m)
        np.minimum.at(now, label[b], m)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _verifier(limit: int, split: int):
    def verify(table: pa.Table) -> pa.Table:
        bucket, every_id, fps = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in zip(_PACKED[1:], (np.uint32, np.int64, np.uint8)))
        fps = fps.reshape(len(every_id), _BYTES)
        ids, first, place = np.unique(every_id, return_index=True, return_inverse=True)
        keys, rows = full_keys(bucket, fps, split)
        words = np.zeros((len(ids), _WORDS * 8), np.uint8)
        words[:, :_BYTES] = fps[first]
        a, b = near_pairs(keys, place[rows], words.view(np.uint64), limit)
        label = _labels(len(ids), a, b)
        moved = np.flatnonzero(ids[label] != ids)
        return pa.table({"u": pa.array(ids[moved], pa.int64()), "v": pa.array(ids[label[moved]], pa.int64())})

    return verify


#: Bytes of packed buckets that one task holds at once, about; bytes that a fingerprint has there; parts that whole buckets are dealt to.
PART_BYTES, BUCKET_BYTES, WHOLE_PARTS = 8 << 20, 1100, 4096


def near_edges(reps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (u, v) that connect near fingerprints; ``reps`` is (doc_id, fp).

    Parts are as many as their size asks. Where there are more than whole buckets fill
    evenly, buckets are split by their second key, so they stay small at any size.
    """
    spark = reps.sparkSession
    n = reps.count()
    parts = max(partitions(spark), -(-n * BUCKET_BYTES // PART_BYTES))
    split = min(12, max(0, (-(-parts // WHOLE_PARTS) - 1).bit_length()))
    tasks = max(min(partitions(spark), -(-n // _CHUNK)), -(-n // (16 * _CHUNK)), 1)
    packed = reps.repartition(tasks).mapInArrow(_emitter(parts, split), "part int, buckets binary, ids binary, fps binary")
    return packed.groupBy("part").applyInArrow(_verifier(max_distance, split), "u long, v long")


#: Fingerprints of a group that a task compares with each other at once; rows of one part of such blocks, about.
LINK_BLOCK, LINK_ROWS = 4096, 100_000


def _near_counts(a: np.ndarray, b: np.ndarray, weights_a: np.ndarray, weights_b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a the weights of the rows of b near it, and the other way round."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for at in range(0, len(a), 256):
        near = _near(a[at : at + 256, None], b[None], limit)
        of_a[at : at + 256] = near @ weights_b
        of_b += weights_a[at : at + 256] @ near
    return of_a, of_b


def _link_counter(limit: int):
    def count(table: pa.Table) -> pa.Table:
        group, i, j, own, reps, n = (np.asarray(table.column(c)) for c in ("keep_id", "i", "j", "block", "rep", "n"))
        words = np.zeros((len(reps), _WORDS * 8), np.uint8)
        words[:, :_BYTES] = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(reps), -1)[:, :_BYTES]
        words, links = words.view(np.uint64), np.zeros(len(reps), np.int64)
        order = np.lexsort((own, j, i, group))
        keys = np.stack([group, i, j])[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for rows in np.split(order, cuts):
            if i[rows[0]] == j[rows[0]]:
                links[rows] = _near_counts(words[rows], words[rows], n[rows], n[rows], limit)[0] - n[rows]
            else:
                left, right = rows[own[rows] == i[rows]], rows[own[rows] == j[rows]]
                links[left], links[right] = _near_counts(words[left], words[right], n[left], n[right], limit)
        return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(links)})

    return count


def _links(classes: DataFrame, max_distance: int) -> DataFrame:
    """(rep, links): of each fingerprint of a group how many documents have another one of it
    that is near. A group's fingerprints are dealt to blocks by hash, and each pair of
    blocks is a piece of work of its own, so no task has a whole group; counts leave it,
    never pairs."""
    sizes = classes.groupBy("keep_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / LINK_BLOCK))
    sizes = materialise(sizes, "group-sizes")
    rows = sizes.agg(F.coalesce(F.sum(F.col("m") * F.col("blocks")), F.lit(0))).first()[0]
    parts = max(partitions(classes.sparkSession), -(-rows // LINK_ROWS))
    own = classes.join(sizes, "keep_id").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("keep_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "fp")
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("keep_id", "i", "j"), F.lit(parts)))
    return parted.groupBy("part").applyInArrow(_link_counter(max_distance), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _classes(docs: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all documents, and (fp, rep, n, keep_id) of the fingerprints that are in a
    group: the smallest doc_id that has it, how many have it, and the group's smallest."""
    prints = materialise(fingerprints(docs).groupBy("doc_id").agg(F.min("fp").alias("fp")), "fingerprints")
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "representatives")
    joined = components(near_edges(reps.select(F.col("rep").alias("doc_id"), "fp"), max_distance))
    labels = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    found = reps.join(labels, F.col("rep") == F.col("node"), "left").where("root IS NOT NULL OR n > 1")
    return prints, materialise(found.select("fp", "rep", "n", F.coalesce("root", "rep").alias("keep_id")), "classes")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, keep_id, links) for each document in a group of two or more near copies.

    keep_id is the group's smallest doc_id; its own row has keep_id = doc_id. Near
    means that the fingerprints differ in ``max_distance`` bits at most; groups are
    the connected components of that relation, and links is how many other documents of
    the group are near to this one. Words count once each, those of more than
    40 characters by their 5-grams. Documents without an id, with null
    text or without a single word belong to no group. Rows that repeat a doc_id are
    one document; of different texts the least fingerprint counts. Ties can't arise: ids order everything. No rows in, no rows out.
    Columns other than doc_id and text are not looked at.
    """
    prints, classes = _classes(docs, max_distance)
    counted = classes.join(_links(classes, max_distance), "rep", "left").select("fp", "keep_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return prints.join(counted, "fp").select("doc_id", "keep_id", "links")


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents, with one of each group of near copies: that of the smallest doc_id.

    All columns stay as they are. Rows that share a doc_id are one document and stay
    or go together; rows without an id or without words stay.
    """
    prints, classes = _classes(docs, max_distance)
    gone = prints.join(classes, "fp").where("doc_id <> keep_id").select(F.col("doc_id").alias("_gone"))
    gone = materialise(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
