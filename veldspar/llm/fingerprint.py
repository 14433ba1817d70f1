"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Every paragraph is hashed to a wide vector, 32 lanes of 32 bits (four SHA-256 digests,
each of the paragraph behind another digit). A document's fingerprint is the sum of
its paragraphs' vectors, lane by lane, modulo 2**32: it doesn't depend on their order,
and a paragraph is put in or taken out by adding or subtracting its vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values

BLOCKS = 4
LANES = 8 * BLOCKS
ZERO = "0" * (8 * LANES)


def _vectors(paragraphs: Iterable[bytes]) -> np.ndarray:
    digests = b"".join(hashlib.sha256(b"%d" % i + p).digest() for p in paragraphs for i in range(BLOCKS))
    return np.frombuffer(digests, ">u4").reshape(-1, LANES)


def _hex(lanes: np.ndarray) -> str:
    return lanes.astype(">u4").tobytes().hex()


def _lanes(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def paragraphs_of(text: str) -> list[bytes]:
    """The lines of a text, trimmed of spaces, without empty ones."""
    return [p for line in text.split("\n") if (p := line.strip(" ").encode("utf-8", "surrogatepass"))]


def fingerprint(paragraphs: Iterable[bytes]) -> str:
    return _hex(_vectors(paragraphs).sum(axis=0, dtype=np.uint64).astype(np.uint32))


def inserted(fingerprint_: str, paragraphs: Iterable[bytes]) -> str:
    """The fingerprint once more paragraphs are in."""
    return _hex(_lanes(fingerprint_) + _vectors(paragraphs).sum(axis=0, dtype=np.uint64).astype(np.uint32))


def deleted(fingerprint_: str, paragraphs: Iterable[bytes]) -> str:
    """The fingerprint once paragraphs that were in are out."""
    return _hex(_lanes(fingerprint_) - _vectors(paragraphs).sum(axis=0, dtype=np.uint64).astype(np.uint32))


def combined(fingerprints: Iterable[str]) -> str:
    """The fingerprint of all documents' paragraphs together."""
    total = np.zeros(LANES, np.uint32)
    for f in fingerprints:
        total += _lanes(f)
    return _hex(total)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, prints = [], []
        for (text,) in zip(*column_values(batch, "text")):
            found = None if text is None else paragraphs_of(text)
            counts.append(None if found is None else len(found))
            prints.append(None if found is None else fingerprint(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(prints, pa.string())], ["doc_id", "paragraphs", "fingerprint"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, fingerprint in hexadecimal) for each row of docs.

    Paragraphs are lines, trimmed of spaces; empty ones don't count. A text without any
    has the fingerprint zero, a null text null. doc_id may be null and may repeat; each
    row stands for itself. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run, "doc_id long, paragraphs int, fingerprint string")


_SQL_LANES = ", ".join(f"printf('%08x', (coalesce(sum(('0x' || substr(h{i // 8}, {i % 8 * 8 + 1}, 8))::BIGINT), 0) % 4294967296)::BIGINT)" for i in range(LANES))

#: DuckDB, for document_fingerprints(documents).
FINGERPRINTS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
lines AS (SELECT row, trim(line, ' ') AS line FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)),
hashed AS (SELECT row, {', '.join(f"sha256('{i}' || line) AS h{i}" for i in range(BLOCKS))} FROM lines WHERE line <> ''),
summed AS (SELECT row, count(*) AS n, concat({_SQL_LANES}) AS fingerprint FROM hashed GROUP BY row)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END::INT AS paragraphs,
       CASE WHEN text IS NOT NULL THEN coalesce(fingerprint, '{ZERO}') END AS fingerprint
FROM docs LEFT JOIN summed USING (row)
"""
