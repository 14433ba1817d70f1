"""Language identification: known words first, then ever shorter character n-grams.

Of each language the model has the log frequencies of words. A word that no language
knows is scored by its character n-grams of 5, or else of 4, 3, 2 and 1: the longest
order of which any n-gram is known. A text's score for a language is the mean over
its words; the margin between the two best languages tells how sure the answer is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, column_values, materialise

LETTERS = re.compile(r"[^\W\d_]+")

#: Labelled documents of each language that the model is fitted on at most, those of the least hashes of doc_id; words and n-grams of a language that it keeps.
SAMPLE_DOCS, KEEP_WORDS, KEEP_GRAMS = 1000, 20_000, 20_000
ORDERS = (5, 4, 3, 2, 1)
#: Mean log-odds a word by which the best language must lead the next.
MIN_MARGIN = 0.05


class Model:
    """Log frequencies of words and n-grams in each language: dicts of arrays.

    Words, and unseen ones once they are scored, have a row in one matrix, so that a text
    costs a lookup for each distinct word and one product.
    """

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        self.languages, self.words, self.grams = languages, words, grams
        self._forget()

    def __getstate__(self):
        keys = lambda d: (list(d), np.stack(list(d.values())) if d else np.zeros((0, len(self.languages)), np.float32))
        return self.languages, keys(self.words), keys(self.grams)

    def __setstate__(self, state):
        languages, (w, wv), (g, gv) = state
        self.__init__(languages, dict(zip(w, wv)), dict(zip(g, gv)))

    def _forget(self) -> None:
        self._row = dict(zip(self.words, range(len(self.words))))
        self._rows = np.zeros((len(self.words) + 1024, len(self.languages)), np.float32)
        if self.words:
            self._rows[: len(self.words)] = list(self.words.values())

    def _add(self, word: str) -> int:
        row = self._row[word] = len(self._row)
        if row >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        self._rows[row] = self._backoff(word)
        return row

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language, by backoff."""
        known = self.words.get(word)
        return self._backoff(word) if known is None else known

    def _backoff(self, word: str) -> np.ndarray:
        padded, grams = f"^{word}$", self.grams
        for n in ORDERS:
            found = [grams[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in grams]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.languages), np.float32)

    def score(self, text: str | None) -> tuple[str | None, float, int]:
        """(language, margin, words); no language for a text without letters. Ties go to
        the language that sorts first."""
        counts = Counter(LETTERS.findall(text.lower())) if text else {}
        n = sum(counts.values())
        if not n or not self.languages:
            return None, 0.0, n
        if len(self._row) > len(self.words) + REMEMBERED // 2:
            self._forget()
        get, add = self._row.get, self._add
        rows = [add(w) if (r := get(w)) is None else r for w in counts]
        scores = np.fromiter(counts.values(), np.float64, len(counts)) @ self._rows[rows] / n
        order = np.argsort(-scores, kind="stable")
        return self.languages[order[0]], float(scores[order[0]] - scores[order[1]]) if len(order) > 1 else math.inf, n


def _log_frequencies(counts: dict[str, dict[str, int]], languages: list[str], keep: int, group=lambda key: 0) -> dict[str, np.ndarray]:
    """Of the ``keep`` most frequent keys of each language: add-half log frequencies,
    within the key's group."""
    kept: set[str] = set()
    totals: dict = defaultdict(int)
    for lang in languages:
        c = counts.get(lang, {})
        kept.update(sorted(c, key=lambda k: (-c[k], k))[:keep])
        for k, v in c.items():
            totals[lang, group(k)] += v
    sizes = Counter(map(group, kept))
    rows = {}
    for k in sorted(kept):
        g = group(k)
        rows[k] = np.array([math.log((counts.get(lang, {}).get(k, 0) + 0.5) / (totals[lang, g] + 0.5 * sizes[g])) for lang in languages], np.float32)
    return rows


def fit(word_counts: dict[str, dict[str, int]], keep_words: int = KEEP_WORDS, keep_grams: int = KEEP_GRAMS) -> Model:
    """A model of the word counts of each language."""
    languages = sorted(word_counts)
    grams: dict[str, Counter] = {}
    for lang in languages:
        own = grams[lang] = Counter()
        for word, n in word_counts[lang].items():
            padded = f"^{word}$"
            for order in ORDERS:
                for i in range(len(padded) - order + 1):
                    own[padded[i : i + order]] += n
    return Model(languages, _log_frequencies(word_counts, languages, keep_words), _log_frequencies(grams, languages, keep_grams, len))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(*column_values(batch, "lang", "text")):
            counts[lang].update(LETTERS.findall(text.lower()))
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    cols = list(zip(*rows)) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, keep_words: int = KEEP_WORDS, keep_grams: int = KEEP_GRAMS) -> Model:
    """Fit on the whole texts of at most ``sample_docs`` documents of each language
    (column lang). Which those are depends on their ids alone. Of each language the
    ``2 * keep_words`` most frequent words of the sample are counted."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = materialise(labelled.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= sample_docs).select("doc_id", "lang").distinct(), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL")
    sample = texts.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")
    counted = sample.mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("_rank", F.row_number().over(by_count)).where(F.col("_rank") <= 2 * keep_words)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in top.select("lang", "word", "n").collect():
        counts[lang][word] = n
    return fit(counts, keep_words, keep_grams)


def _labeller(shared, min_margin: float, names: tuple[str, ...]):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            langs, margins, words = zip(*map(model.score, texts)) if texts else ((), (), ())
            keep = [lang is not None and m >= min_margin for lang, m in zip(langs, margins)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(margins, pa.float64()), pa.array(words, pa.int32()), pa.array(keep, pa.bool_())], list(names))

    return label


def identify(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, language, margin, words, keep), a row for each row of docs.

    A null or empty text, or one without letters, has no language (null), margin 0 and
    isn't kept; nor is one whose margin is below ``min_margin``. Ties go to the language
    that sorts first. With one known language the margin is infinite, with none every
    text is without language. doc_id may be null and may repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_labeller(shared, min_margin, ("doc_id", "language", "margin", "words", "keep")), "doc_id long, language string, margin double, words int, keep boolean")


def keep_identified(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs whose language is recognised; all columns stay.

    The decision is made where the row is: the text goes through the model and the row
    on, with no join. A row's own null or repeated id doesn't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def recognised(texts: "pd.Series") -> "pd.Series":
        scored = map(shared.value.score, texts)
        return pd.Series([lang is not None and margin >= min_margin for lang, margin, _ in scored], dtype=bool)

    return docs.where(recognised(F.col("text").cast("string")))
