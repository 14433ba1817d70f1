"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words, compared by their 64-bit hashes. Windows of
``MIN_MATCH`` words that a document shares with an item, found by running Karp-Rabin
hashes, are the seeds. Candidates are the pairs whose seeds cover enough of the item; on
each, greedy string tiling marks the longest match of unmarked words again and again, so
that a passage whose sentences were put in another order is found as well. The share of
the item's words in tiles is its coverage.

Tiling looks for long matches first, by windows of 2**k words, and halves k once all of
that length are marked, so shorter ones are looked for among few words. Of a match only
the place where it begins is listed, straight from sorted hashes, never all pairs of
equal windows, so texts of repeated words take no more than their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_values, keyed_texts, materialise, rolling, words_of

#: Words in the shortest tile, share of an item's words in tiles from which a document is contaminated.
MIN_MATCH, THRESHOLD = 4, 0.5
#: Words of the shortest item that can have a tile. Items of fewer than ``WHOLE_WORDS`` must be found whole and in one piece, as a single tile says little.
MIN_ITEM_WORDS, WHOLE_WORDS = MIN_MATCH, 8
#: Characters of benchmark text whose index travels to every task at once; of more there are several slices.
BROADCAST_CHARS = 16 << 20

# --- tiling -----------------------------------------------------------------------


class _Side:
    """The words of an item or document, what is marked of them, and hashes of windows."""

    def __init__(self, words: np.ndarray, places: np.ndarray | None = None) -> None:
        self.n, self.words = len(words), words
        self.places = np.arange(self.n) if places is None else places
        gap = np.ones(self.n, bool)  # before the word: it doesn't follow on the one before
        gap[1:] = np.diff(self.places) != 1
        self.gaps = np.r_[0, np.cumsum(gap)]
        self.joined = ~gap
        self.taken = np.zeros(self.n, bool)
        self.levels: dict[int, np.ndarray] = {}
        self.count()

    def count(self) -> None:
        self.marked = np.r_[0, np.cumsum(self.taken)]

    def hashes(self, width: int) -> np.ndarray:
        if width not in self.levels:
            self.levels[width] = rolling(self.words, width)
        return self.levels[width]

    def free(self, at: np.ndarray, width: int) -> np.ndarray:
        """Whether the window at each place is within one piece and has no marked word."""
        inside = at + width <= self.n
        at = np.where(inside, at, 0)
        to = np.minimum(at + width, self.n)
        return inside & (self.marked[to] == self.marked[at]) & (self.gaps[to] == self.gaps[np.minimum(at + 1, self.n)])

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each place, and whether there is one that isn't marked."""
        prior = np.maximum(at - 1, 0)
        return self.words[prior], (at > 0) & self.joined[at] & ~self.taken[prior]


def _matches(item: _Side, doc: _Side, width: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place in item, place in doc) of the maximal matches of unmarked words, of
    ``width`` words or more and less than ``limit``."""
    i = np.arange(max(0, item.n - width + 1))
    i = i[item.free(i, width)]
    if not len(i):
        return i, i, i
    hi = item.hashes(width)[i]
    hd = doc.hashes(width)
    j = np.flatnonzero(np.isin(hd, hi))
    j = j[doc.free(j, width)]
    word, there = doc.before(j)
    order = np.lexsort((word, there, hd[j]))
    j, word, there = j[order], word[order], there[order]
    hd = hd[j]
    # of each item window the range of equal document windows; those that the word before joins to are within longer matches
    low, high = np.searchsorted(hd, hi), np.searchsorted(hd, hi, "right")
    i, low, high = (x[high > low] for x in (i, low, high))
    own, has = item.before(i)
    start = np.cumsum(np.r_[0, hd[1:] != hd[:-1]]) if len(hd) else np.empty(0, np.int64)
    # (group, there, word) as one sortable key of positions in the list of distinct keys
    keys = np.rec.fromarrays([start.astype(np.int64), there.astype(np.int64), word], names="g,t,w")
    wanted = np.rec.fromarrays([start[low].astype(np.int64), np.ones(len(low), np.int64), own], names="g,t,w")
    both = np.concatenate([keys, wanted])
    rank = np.unique(both, return_inverse=True)[1]
    doc_rank, own_rank = rank[: len(keys)], rank[len(keys) :]
    same_low = np.where(has, np.searchsorted(doc_rank, own_rank), low)
    same_high = np.where(has, np.searchsorted(doc_rank, own_rank, "right"), low)
    firsts, counts = np.r_[low, same_high], np.r_[same_low - low, high - same_high]
    total = int(counts.sum())
    at = np.repeat(firsts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)
    i, j = np.repeat(np.r_[i, i], counts), j[at]
    n = np.full(total, width)
    step = 1 << (max(1, limit - width) - 1).bit_length()
    while step:
        ok = item.free(i + n, step) & doc.free(j + n, step) & (j + n < doc.n)
        ok[ok] = doc.joined[(j + n)[ok]] & item.joined[(i + n)[ok]]
        ok[ok] = item.hashes(step)[(i + n)[ok]] == doc.hashes(step)[(j + n)[ok]]
        n += np.where(ok, step, 0)
        step //= 2
    return n, i, j


#: Matches in a row that turn out to be marked, after which those that are left are looked through at once.
_STALE = 64


def _mark(item: _Side, doc: _Side, width: int, limit: int, tiles: list[tuple[int, int, int]]) -> None:
    """Greedy marking of all matches of ``width`` words or more; none has ``limit``."""
    n, i, j = _matches(item, doc, width, limit)
    order = np.lexsort((j, i, -n))
    n, i, j = n[order], i[order], j[order]
    heap: list[tuple[int, int, int]] = []
    at, stale = 0, 0
    while at < len(n) or heap:
        if heap and (at >= len(n) or heap[0] <= (-n[at], i[at], j[at])):
            minus, a, b = heapq.heappop(heap)
            k = -minus
        else:
            k, a, b = int(n[at]), int(i[at]), int(j[at])
            at += 1
        marked = item.taken[a : a + k] | doc.taken[b : b + k]
        if not marked.any():
            tiles.append((a, int(doc.places[b]), k))
            item.taken[a : a + k] = doc.taken[b : b + k] = True
            continue
        stale += 1
        edges = np.flatnonzero(np.diff(np.r_[True, marked, True].astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= width:
                heapq.heappush(heap, (s - e, a + s, b + s))
        if stale >= _STALE and at < len(n):
            item.count(), doc.count()
            n, i, j = n[at:], i[at:], j[at:]
            left = np.minimum(n - item.marked[i + n] + item.marked[i], n - doc.marked[j + n] + doc.marked[j]) >= width
            n, i, j, at, stale = n[left], i[left], j[left], 0, 0
    item.count(), doc.count()


def tile(item, doc, near: np.ndarray | None = None, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words): longest first, ties by place in the
    item, then in the document. Both are lists of words or arrays of their hashes.
    ``near``: the document's places, ascending, where a window of ``min_match`` words begins
    that the item has (looked for, if None)."""
    a, b = (w if isinstance(w, np.ndarray) else WordHashes().of(w) for w in (item, doc))
    if near is None:
        near = np.flatnonzero(np.isin(rolling(b, min_match), rolling(a, min_match)))
    if not len(near):
        return []
    kept = np.zeros(len(b) + 1, np.int64)
    np.add.at(kept, near, 1)
    np.add.at(kept, near + min_match, -1)
    places = np.flatnonzero(np.cumsum(kept)[:-1])
    left, right = _Side(a), _Side(b[places], places)
    tiles: list[tuple[int, int, int]] = []
    limit = 1 << min(left.n, right.n).bit_length()
    while limit > min_match:
        width = max(min_match, limit // 2)
        _mark(left, right, width, limit, tiles)
        limit = width
    return tiles


def judge(item: np.ndarray, doc: np.ndarray, near: np.ndarray, threshold: float, min_match: int, whole_words: int) -> tuple[float, int] | None:
    """(coverage, number of tiles) if it reaches the threshold; of short items, if the whole
    is one tile."""
    tiles = tile(item, doc, near, min_match)
    covered = sum(n for _, _, n in tiles) / len(item)
    if len(item) < whole_words:
        return (covered, 1) if covered == 1 and len(tiles) == 1 else None
    return (covered, len(tiles)) if covered >= threshold else None


# --- the benchmark's index -----------------------------------------------------------


class Index:
    """Benchmark items by the hashes of their windows; small enough to be sent to tasks."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, threshold: float = THRESHOLD, whole_words: int = WHOLE_WORDS) -> None:
        known = WordHashes()
        words = [(i, known.of(words_of(t))) for i, t in items]
        words = [(i, w) for i, w in words if len(w) >= min_match]
        self.min_match, self.threshold, self.whole_words = min_match, threshold, whole_words
        self.ids = np.array([i for i, _ in words], np.int64)
        self.sizes = np.array([len(w) for _, w in words], np.int64)
        self.at = np.r_[0, np.cumsum(self.sizes)]
        self.words = np.concatenate([w for _, w in words]) if words else np.empty(0, np.uint64)
        #: Words in tiles that an item needs.
        self.needs = np.where(self.sizes < whole_words, self.sizes, threshold * self.sizes)
        rolled = [rolling(w, min_match) for _, w in words]
        hashes = np.concatenate(rolled) if rolled else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(r) for r in rolled])
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        first = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]
        starts = np.flatnonzero(first)
        #: Of each window and item that has it: the item, and how often.
        self.owner, self.often = owner[starts], np.diff(np.r_[starts, len(hashes)]).astype(np.int32)
        self.sorted, self.first = np.unique(hashes[starts], return_index=True)
        self.first = np.r_[self.first, len(starts)].astype(np.int64)
        self.bits = max(16, int(len(self.sorted) * 4).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.sorted >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.words[self.at[k] : self.at[k + 1]]

    def matches(self, hashes: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, item's words) of the items that a document, given by the
        hashes of its words, covers enough of."""
        if not len(self.sorted):
            return
        rolled = rolling(hashes, self.min_match)
        maybe = np.flatnonzero(self.seen[(rolled >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(maybe):
            return
        found = np.searchsorted(self.sorted, rolled[maybe])
        found[found == len(self.sorted)] = 0
        real = self.sorted[found] == rolled[maybe]
        maybe, found = maybe[real], found[real]
        if not len(maybe):
            return
        which = np.unique(found)
        low, counts = self.first[which], self.first[which + 1] - self.first[which]
        pairs = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        owners, place = np.unique(self.owner[pairs], return_inverse=True)
        # shared windows cover ``min_match`` words each at most
        bound = np.bincount(place, self.often[pairs], len(owners)) * self.min_match
        rolled = rolled[maybe]
        for k in owners[bound >= self.needs[owners]].tolist():
            item = self.item(k)
            windows = rolling(item, self.min_match)
            shared = np.r_[np.isin(windows, rolled), np.zeros(self.min_match - 1, bool)]
            before = np.r_[0, np.cumsum(shared)]
            at = np.arange(len(item))
            if (before[at + 1] > before[np.maximum(at - self.min_match + 1, 0)]).sum() < self.needs[k]:
                continue
            near = maybe[np.isin(rolled, windows)]
            result = judge(item, hashes, near, self.threshold, self.min_match, self.whole_words)
            if result:
                yield int(self.ids[k]), *result, len(item)


_OUT = "doc_id long, item_id long, coverage double, tiles int, item_words int"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in _OUT.split(", ")])


def _by_index(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(*column_values(batch, "doc_id", "text")):
                words = words_of(text)
                if len(words) >= index.min_match:
                    rows += [(doc, *r) for r in index.matches(known.of(words))]
            yield _out(rows)

    return match


def _slices(items: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """The items with a column ``slice``, and the slices there are: none has more than
    ``most`` characters, unless a single item has."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item").cast("long")), F.lit(0)).alias("chars")).first()
    n = 1 if total.chars <= most else min(total.n, max(2, -(-2 * total.chars // max(1, most))))
    while True:
        cut = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "item"), F.lit(n)).cast("int"))
        if n == 1:
            return cut, [0] if total.n else []
        sizes = {r["slice"]: (r.n, r.chars) for r in cut.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item").cast("long")).alias("chars")).collect()}
        if n >= 4 * total.n or all(chars <= most or k == 1 for k, chars in sizes.values()):
            return cut, sorted(sizes)
        n *= 2


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, broadcast_chars: int = BROADCAST_CHARS, whole_words: int = WHOLE_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, item_words) of each document and benchmark item
    of which at least ``threshold`` of the words lie in tiles shared with the document.

    The size of the benchmark is looked at first. Its index goes to every task in slices of
    up to ``broadcast_chars`` characters, and each slice takes one pass over the documents,
    with no shuffle. An item's matches don't depend on the slice it is in.

    Items of less than ``whole_words`` words count only if the document has the whole item
    as one tile; those of less than ``min_match`` words, the shortest tile, match nothing.
    Rows without id or text match nothing. Repeated rows give one row; coverage of a
    repeated doc_id or item_id is the greatest. Texts may have any length and repeat
    themselves. Empty in, empty out. Other columns aren't looked at.
    """
    texts, spark = keyed_texts(docs), docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL").distinct()
    items, slices = _slices(items, broadcast_chars)
    found = spark.createDataFrame([], _OUT)
    for s in slices:
        index = Index(sorted((r.item_id, r.item) for r in items.where(F.col("slice") == s).collect()), min_match, threshold, whole_words)
        part = texts.mapInArrow(_by_index(spark.sparkContext.broadcast(index)), _OUT)
        found = part if len(slices) == 1 else found.unionByName(materialise(part, "matches"))
    best = F.max(F.struct("coverage", "tiles", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", "best.tiles", "best.item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that cover no benchmark item up to the threshold; columns stay, and
    so do rows without id or text. Rows that share a doc_id stay or go together. An empty
    table stays empty; without benchmark items all documents stay."""
    gone = materialise(contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_gone")).distinct(), "leaked")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
