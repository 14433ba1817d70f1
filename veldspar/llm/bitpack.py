"""Token ids, packed into the fewest bits that the vocabulary needs.

A document's ids are cut into blocks of ``BLOCK``; within a block every id takes
``width`` bits, the lowest first, and the last byte is filled up with zeros. The
offsets of the blocks allow any block to be unpacked alone, and any id to be read
from the few bytes it lies in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values

BLOCK = 4096
TOKENIZER, VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50_257
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are encoded at once, about.
PIECE = 1 << 20


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary of this size, 1 at least."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has one id at least")
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ids.astype("<u8")[:, None].view(np.uint8)
    return np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack_block(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def pack(ids, width: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """(packed bytes, offsets of the blocks and of the end)."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> width):
        raise ValueError(f"an id doesn't fit {width} bits")
    blocks = [pack_block(ids[i : i + block], width) for i in range(0, len(ids), block)]
    return b"".join(blocks), [0, *np.cumsum([len(b) for b in blocks]).tolist()] if blocks else [0]


def unpack(data: bytes, offsets: list[int], n: int, width: int, block: int = BLOCK) -> np.ndarray:
    parts = [unpack_block(data[a:b], min(block, n - i * block), width) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def token_at(data: bytes, offsets: list[int], i: int, width: int, block: int = BLOCK) -> int:
    """The i-th id, from the bytes that hold it."""
    bit = i % block * width
    first = offsets[i // block] + bit // 8
    window = int.from_bytes(data[first : first + (bit % 8 + width + 7) // 8], "little")
    return window >> bit % 8 & (1 << width) - 1


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a rank file (lines of a base64 token and its rank)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces that are encoded the same apart: cut before a space that
    has a letter on both sides."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str | None, path: str = TOKENIZER) -> np.ndarray | None:
    if text is None:
        return None
    enc = encoder(path)
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), np.int64)
    return np.concatenate([np.array(enc.encode_ordinary(p), np.int64) for p in pieces(text)])


def _packer(path: str, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, data, offsets = [], [], []
            for (text,) in zip(*column_values(batch, "text")):
                ids = encode(text, path)
                packed, at = (None, None) if ids is None else pack(ids, width, block)
                counts.append(None if ids is None else len(ids))
                data.append(packed)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([width] * len(counts), pa.int32()), pa.array([block] * len(counts), pa.int32()), pa.array(offsets, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                ["doc_id", "n_tokens", "width", "block", "offsets", "packed"],
            )

    return run


def packed_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, vocabulary: int = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, width, block, offsets, packed) for each row of docs.

    A null text has null n_tokens, offsets and packed; an empty one has no tokens, an
    empty packed and the single offset 0. doc_id may be null and may repeat; each row
    stands for itself. Texts of any length are encoded whole. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_packer(tokenizer, width_of(vocabulary), block), "doc_id long, n_tokens long, width int, block int, offsets array<long>, packed binary")


def unpacked_tokens(packed: DataFrame) -> DataFrame:
    """(doc_id, tokens array<long>) of what packed_tokens made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if d is None else unpack(d, o, n, w, b) for n, w, b, o, d in zip(*column_values(batch, "n_tokens", "width", "block", "offsets", "packed"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return packed.select("doc_id", "n_tokens", "width", "block", "offsets", "packed").mapInArrow(run, "doc_id long, tokens array<long>")


def write_token_files(packed: DataFrame, path: str) -> None:
    """Token rows as a Parquet table of packed blocks, one row group after another; read
    it with spark.read.parquet, or unpack single blocks by their offsets."""
    packed.write.option("parquet.enable.dictionary", "false").parquet(path)
