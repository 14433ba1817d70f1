"""Recurring passages: word-seed candidates, confirmed and located by Aho-Corasick automata.

1. Every document is winnowed: of each 31 successive windows of 20 words the one with
   the smallest Karp-Rabin hash is a seed. Any passage of 50 words holds a seed, and
   it is the same in every document that has the passage.
2. A seed that two documents share is recurring. Of documents with recurring seeds,
   every window of 50 words whose seed recurs is hashed, and the smallest doc_id that
   has a window is the window's reference. So documents that have only a part of a
   passage, however small their ids, don't hide the others that share more of it.
3. Each document goes to the shard of each of its references, and so does the
   reference itself. Documents that share a window so meet in a shard; those that
   share nothing go nowhere.
4. In a shard, the references are cut into tiles of 25 words, which an automaton over
   word ids is compiled of. All the shard's documents stream through it, and each
   tile found is extended, word by word, as far as document and reference agree. What
   reaches ``MIN_WORDS`` is a confirmed run, a row with its own reference, if it has a
   window of that many words that no run before it with the same reference has. So
   every shared window is in a row, while what repeats many times in both texts gives
   no row for each pair of places.
   A run of 49 words or more always holds a whole tile, so none is missed.

A reference that very many documents share has several shards, each with the
reference and a part of the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WordHashes, column_values, keyed_texts, materialise, rolling, words_of

#: Words in the shortest passage that counts.
MIN_WORDS = 50
SEED_WORDS = 20
TILE = MIN_WORDS // 2
#: Words of documents that a shard has, about.
SHARD_WORDS = 1_000_000


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive hashes."""
    least, span = hashes, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the least of some ``width`` successive ones."""
    n = len(hashes)
    if n <= width:
        return np.flatnonzero(hashes == hashes.min()) if n else np.empty(0, np.int64)
    least = _least(hashes, width)
    # least[j] is over hashes[j : j + width]; the greatest of the windows that hold i
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most, span = padded, 1
    while span < width:
        step = min(span, width - span)
        most = np.maximum(most[: len(most) - step], most[step:])
        span += step
    return np.flatnonzero(most == hashes)


def _pairs_of(column: list[tuple[int, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    """One batch of (name, doc_id) from the hashes of each document."""
    if column:
        hashes = np.concatenate([h for _, h in column]).view(np.int64)
        docs = np.repeat(np.array([d for d, _ in column], np.int64), [len(h) for _, h in column])
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(docs)], [name, "doc_id"])


def seeds_of(hashes: np.ndarray, min_words: int = MIN_WORDS, k: int = SEED_WORDS) -> np.ndarray:
    """The distinct seeds of a document of ``min_words`` or more."""
    return np.unique(_least(rolling(hashes, k), min_words - k + 1))


def windows_of(hashes: np.ndarray, seeds: np.ndarray, min_words: int = MIN_WORDS, k: int = SEED_WORDS) -> np.ndarray:
    """The distinct windows of ``min_words`` of a document whose seed is one of these."""
    return np.unique(rolling(hashes, min_words)[np.isin(_least(rolling(hashes, k), min_words - k + 1), seeds)])


def _seeder(min_words: int, k: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = []
            for doc, text in zip(*column_values(batch, "doc_id", "text")):
                words = words_of(text)
                if len(words) >= min_words:
                    found.append((doc, seeds_of(known.of(words), min_words, k)))
            yield from _pairs_of(found, "h")

    return seeds


def _windower(min_words: int, k: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found, counts = [], []
            for doc, text, seeds in zip(*column_values(batch, "doc_id", "text", "seeds")):
                words = words_of(text)
                if len(words) >= min_words:
                    w = windows_of(known.of(words), np.array(seeds, np.int64).view(np.uint64), min_words, k)
                    found.append((doc, w))
                    counts.append(np.full(len(w), len(words), np.int32))
            for pairs in _pairs_of(found, "w"):
                yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(np.concatenate(counts))], ["w", "doc_id", "words"])

    return windows


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = len(self) + 1
        return value


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of a and b are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        to = min(n, at + step)
        differ = np.flatnonzero(a[at:to] != b[at:to])
        if len(differ):
            return at + int(differ[0])
        at, step = to, step * 4
    return n


class _Windows:
    """Hashes of the windows of a shard's documents, computed when asked for."""

    def __init__(self, arrays: dict[int, np.ndarray], min_words: int) -> None:
        self.arrays, self.n = arrays, min_words
        self.hashes: dict[int, np.ndarray] = {}
        self.sorted: dict[int, np.ndarray] = {}

    def of(self, doc: int) -> np.ndarray:
        if doc not in self.hashes:
            mixed = self.arrays[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            self.hashes[doc] = rolling(mixed * np.uint64(0xBF58476D1CE4E5B9), self.n)
        return self.hashes[doc]

    def shared(self, doc: int, ref: int) -> np.ndarray:
        """Of each window of the document, whether the reference has it."""
        if ref not in self.sorted:
            self.sorted[ref] = np.unique(self.of(ref))
        own, theirs = self.of(doc), self.sorted[ref]
        if not len(theirs):
            return np.zeros(len(own), bool)
        at = np.searchsorted(theirs, own)
        at[at == len(theirs)] = 0
        return theirs[at] == own


def runs(texts: dict[int, str], refs_of: dict[int, list[int]], min_words: int = MIN_WORDS) -> tuple[dict[int, list[list]], dict[int, int]]:
    """Of each document runs of ``min_words`` words or more, as [start, end, reference, its
    start, words], that it shares with its references. Each is maximal, has a window that
    no earlier one with the same reference has, and together they have all shared windows.
    A passage that overlaps itself, as repeated words do, is one row from its first place
    to the end of its last. Of a reference itself, the stretches all of whose windows
    these documents have. And how many words each document has.
    ``refs_of``: of each document, its references.
    """
    ids = _Ids()
    arrays = {d: np.fromiter(map(ids.__getitem__, words_of(t)), np.int64, -1) for d, t in texts.items()}
    tile = min_words // 2
    tiles: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for ref in sorted({r for refs in refs_of.values() for r in refs}):
        words = arrays.get(ref, ())
        for t in range(len(words) // tile):
            tiles[tuple(words[t * tile : (t + 1) * tile].tolist())][ref].append(t * tile)
    found: dict[int, list[list]] = defaultdict(list)
    sizes = {d: len(a) for d, a in arrays.items()}
    if not tiles:
        return found, sizes
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, places in tiles.items():
        automaton.add_word(key, places)
    automaton.make_automaton()
    windows, sharers = _Windows(arrays, min_words), defaultdict(list)
    for doc, refs in refs_of.items():
        words, refs = arrays.get(doc), set(refs)
        if words is None:
            continue
        todo: dict[int, np.ndarray] = {}  # of references, the shared windows that are in no run yet
        compared: dict[tuple[int, int], int] = {}  # of diagonals, how far
        last: dict[tuple[int, int, int], list] = {}  # of passages of references, their last row
        for end, places in automaton.iter(tuple(words.tolist())):
            start = end - tile + 1
            for ref in places.keys() & refs:
                if ref not in todo:
                    todo[ref] = windows.shared(doc, ref)
                left_over = todo[ref]
                with_tile = left_over[max(0, start - min_words + tile) : start + 1]
                if not with_tile.any():
                    continue
                other = arrays[ref]
                for at in places[ref]:
                    diagonal = (ref, start - at)
                    if start < compared.get(diagonal, -1):
                        continue
                    right = _agree(words[start:], other[at:])
                    left = _agree(words[:start][::-1], other[:at][::-1])
                    s, e = start - left, start + right
                    compared[diagonal] = e
                    if e - s < min_words or not left_over[s : e - min_words + 1].any():
                        continue
                    left_over[s : e - min_words + 1] = False
                    passage = (ref, at - left, e - s)
                    if passage in last and s <= last[passage][1] - min_words + 1:
                        last[passage][1] = e
                    else:
                        last[passage] = [s, e, ref, at - left, e - s]
                        found[doc].append(last[passage])
                    if not with_tile.any():
                        break
        found[doc] = longest(found[doc])
        for ref in todo:
            sharers[ref].append(doc)
    for ref, docs in sharers.items():
        theirs = np.unique(np.concatenate([windows.of(d) for d in docs]))
        own = np.flatnonzero(np.isin(windows.of(ref), theirs))
        for stretch in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
            s, e = int(stretch[0]), int(stretch[-1]) + min_words
            found[ref].append([s, e, ref, s, e - s])
    return found, sizes


def longest(found: list[list]) -> list[list]:
    """A document's runs without those that lie inside another one with the same reference."""
    kept, reach = [], {}
    for row in sorted(found, key=lambda r: (r[2], r[0], -r[1], r[3])):
        if row[1] > reach.get(row[2], -1):
            kept.append(row)
            reach[row[2]] = row[1]
    return kept


@cache
def _letters() -> np.ndarray:
    """Of each code point, whether it is part of words."""
    every = "".join(map(chr, range(0x110000)))
    table = np.zeros(len(every), bool)
    for m in WORD.finditer(every):
        table[m.start() : m.end()] = True
    return table


def _spans(text: str, n_words: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where the words of a text begin and end; None if lower-casing splits one."""
    inside = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return (edges[::2], edges[1::2]) if len(edges) == 2 * n_words else None


_OUT = "doc_id long, start_word int, end_word int, start_char int, end_char int, ref_doc_id long, ref_start_word int, run_words int"


def _locator(min_words: int):
    def locate(table: pa.Table) -> pa.Table:
        texts, refs_of = {}, {}
        for doc, text, refs in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "refs"))):
            texts[doc] = min(texts.get(doc, text), text)
            if refs:
                refs_of[doc] = sorted(refs)
        out: list[list] = [[] for _ in range(8)]
        all_found, sizes = runs(texts, refs_of, min_words)
        for doc, found in all_found.items():
            spans = _spans(texts[doc], sizes[doc])
            for s, e, ref, rs, n in found:
                for column, value in zip(out, (doc, s, e, int(spans[0][s]) if spans else None, int(spans[1][e - 1]) if spans else None, ref, rs, n)):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return locate


def _own(found: DataFrame, min_words: int) -> DataFrame:
    """References' own rows, of all shards: a reference can be in several, so stretches that
    have all windows between them are put together."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_word") > reach - (min_words - 1), F.lit(True)).cast("int")
    islands = found.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("doc_id", "_island").agg(*(f(c).alias(c) for c, f in (("start_word", F.min), ("end_word", F.max), ("start_char", F.min), ("end_char", F.max))))
    return whole.select("doc_id", "start_word", "end_word", "start_char", "end_char", F.col("doc_id").alias("ref_doc_id"), F.col("start_word").alias("ref_start_word"), (F.col("end_word") - F.col("start_word")).alias("run_words"))


def _joined(found: DataFrame) -> DataFrame:
    """Runs of one document that overlap or touch, as one region."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "ref_doc_id", "ref_start_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("_new", F.coalesce(F.col("start_word") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("ref_doc_id", "ref_start_word"), F.struct("run_words", -F.col("start_word"), -F.col("ref_doc_id"), -F.col("ref_start_word"))).alias("best")
    return (
        islands.groupBy("doc_id", "_island")
        .agg(*(f(c).alias(c) for c, f in (("start_word", F.min), ("end_word", F.max), ("start_char", F.min), ("end_char", F.max), ("run_words", F.max))), best)
        .select("doc_id", "start_word", "end_word", "start_char", "end_char", "best.ref_doc_id", "best.ref_start_word", "run_words")
    )


def recurring_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The regions of documents that ``recurring_runs`` cover: runs joined where they overlap
    or touch. run_words is the length of the longest run of the region, which begins at
    ref_start_word in document ref_doc_id; the region's other references are only in the
    rows of ``recurring_runs``."""
    return _joined(recurring_runs(docs, min_words, seed_words))


def recurring_runs(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Where documents have passages of ``min_words`` words or more that others have too.

    A row is a maximal run that a document shares with a reference document: run_words
    words, from ref_start_word in document ref_doc_id on. From left to right a run has a
    row if it has a window of ``min_words`` that none before it with the same reference
    has, so all shared windows are in rows and each reference of a document has some; one
    inside another with the same reference has none. A
    passage of repeated words, which agrees with itself at other offsets, has one row for
    overlapping places, from the start of the first to the end of the last; elsewhere
    end_word - start_word is run_words. A reference's own rows (ref_doc_id is the document
    itself) are the stretches all of whose windows others have that refer to it.

    Words are runs of letters and digits, compared without case; start_word and end_word
    count them (end exclusive), start_char and end_char are offsets into text, null where
    lower-casing changes how a text divides into words.

    Rows without id, with null or short text have no occurrence. Rows that repeat a
    doc_id are one document, of the text that sorts first. What repeats only within
    one document doesn't count. Empty in, empty out. Other columns aren't looked at.
    """
    texts = keyed_texts(docs)
    seeds = materialise(texts.mapInArrow(_seeder(min_words, seed_words), "h long, doc_id long"), "seeds")
    # a seed or window may be in a third of all documents: counted by map-side aggregates, written, and joined anew, as
    # adaptive execution splits the hot partitions of a join only where both sides are read and shuffled for it
    recurring = materialise(seeds.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h"), "recurring")
    hits = materialise(seeds.join(recurring, "h").groupBy("doc_id").agg(F.collect_set("h").alias("seeds")), "hits")
    windows = texts.join(hits.hint("shuffle_hash"), "doc_id").mapInArrow(_windower(min_words, seed_words), "w long, doc_id long, words int")
    windows = materialise(windows, "windows")
    refs = materialise(windows.groupBy("w").agg(F.min("doc_id").alias("ref_id"), F.max("doc_id").alias("last")).where("ref_id < last").select("w", "ref_id"), "references")
    pairs = materialise(windows.join(refs, "w").where("doc_id <> ref_id").groupBy("doc_id", "ref_id").agg(F.max("words").alias("words")), "pairs")
    load = materialise(pairs.groupBy("ref_id").agg(F.sum("words").alias("n")), "loads")
    total = load.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    load = load.select("ref_id", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).alias("shard"), F.ceil(F.col("n") / SHARD_WORDS).cast("int").alias("subs"))
    routed = pairs.join(load, "ref_id").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("subs")).cast("int").alias("sub"), "doc_id", "ref_id")
    owners = load.select("shard", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.col("ref_id").alias("doc_id"), F.lit(None).cast("long").alias("ref_id"))
    plan = materialise(routed.unionByName(owners).groupBy("shard", "sub", "doc_id").agg(F.collect_set("ref_id").alias("refs")), "routes")
    # the plan is the side that is built: texts pass by it unsorted, at any size alike
    whole = texts.join(plan.hint("shuffle_hash"), "doc_id")
    found = materialise(whole.groupBy("shard", "sub").applyInArrow(_locator(min_words), _OUT), "runs")
    # a document meets a reference in one shard only, but a reference its documents in several
    return found.where("doc_id <> ref_doc_id").unionByName(_own(found.where("doc_id = ref_doc_id"), min_words))
