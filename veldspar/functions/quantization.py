"""Scalar quantisation of vectors to 4, 8, 16, 32 or 64 bits an element."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import doubles

BITS = (4, 8, 16, 32, 64)


def check_bits(bits: int) -> int:
    if bits not in BITS:
        raise ValueError(f"vectors are quantised to one of {BITS} bits, not {bits}")
    return bits


def quantize(v: Column, bits: int) -> Column:
    """Integer codes of 4, 8 and 16 bits, of elements cut to [-1, 1] and rounded half away
    from zero; floats for 32 bits, doubles for 64."""
    check_bits(bits)
    if bits == 64:
        return doubles(v)
    if bits == 32:
        return v.cast("array<float>")
    top = float((1 << bits) - 1)
    return F.transform(doubles(v), lambda x: F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / 2 * top).cast("int"))


def dequantize(codes: Column, bits: int) -> Column:
    check_bits(bits)
    if bits >= 32:
        return doubles(codes)
    return F.transform(codes, lambda c: c / float((1 << bits) - 1) * 2 - 1)


def stored(v: Column, bits: int) -> Column:
    """The vector as a collection of so many bits gives it back."""
    return doubles(v) if bits == 64 else dequantize(quantize(v, bits), bits)


def encoded_size(dimensions: int, bits: int) -> int:
    """Bytes of an encoded vector."""
    return -(-dimensions * check_bits(bits) // 8)


def pack(codes, bits: int) -> bytes:
    """Codes as bytes, big-endian; two 4-bit codes to a byte, the first one high."""
    check_bits(bits)
    if bits == 4:
        padded = np.zeros(len(codes) + len(codes) % 2, np.uint8)
        padded[: len(codes)] = codes
        return (padded[::2] << 4 | padded[1::2]).tobytes()
    return np.asarray(codes).astype({8: ">u1", 16: ">u2", 32: ">f4", 64: ">f8"}[bits]).tobytes()


def unpack(data: bytes, dimensions: int, bits: int) -> np.ndarray:
    check_bits(bits)
    if bits == 4:
        both = np.frombuffer(data, np.uint8)
        return np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:dimensions].astype(np.int64)
    found = np.frombuffer(data, {8: ">u1", 16: ">u2", 32: ">f4", 64: ">f8"}[bits], dimensions)
    return found.astype(np.float64 if bits >= 32 else np.int64)


def packed_column(codes: Column, bits: int) -> Column:
    """pack() of 4-, 8- and 16-bit codes, in the JVM."""
    if check_bits(bits) > 16:
        raise ValueError("floats are stored as they are")
    digits = F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), bits // 4, "0")), "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def unpacked_column(packed: Column, dimensions: Column, bits: int) -> Column:
    """unpack() to 4-, 8- and 16-bit codes, in the JVM."""
    if check_bits(bits) > 16:
        raise ValueError("floats are stored as they are")
    width, digits = bits // 4, F.hex(packed)
    places = F.when(dimensions > 0, F.sequence(F.lit(0), dimensions - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * width + 1, F.lit(width)), 16, 10).cast("int"))
