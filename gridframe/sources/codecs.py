"""Chunk codecs and checksums: raw, zstd, blosc 1 with zstd blocks, byte and bit shuffle, CRC-32C."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: Fixed values of the blosc 1 header's flags.
BYTE_SHUFFLE, RAW, BIT_SHUFFLE, NO_SPLIT, ZSTD_FORMAT = 1, 2, 4, 16, 4 << 5
#: Fixed value: the Castagnoli polynomial, reflected.
CRC32C = 0x82F63B78


class DecodeError(ValueError):
    """Bytes that don't follow their format."""


def _crc_table() -> np.ndarray:
    """The register after one byte, from zero."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C), table >> 1)
    return table


_TABLE = _crc_table()
#: Each entry moves a register over twice as many zero bytes as the one before: four tables, by the register's bytes.
_SHIFTS: list[np.ndarray] = []


def _moved(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = table[0][register & 255]
    for k in range(1, 4):
        out = out ^ table[k][(register >> np.uint32(8 * k)) & 255]
    return out


def _shift(k: int) -> np.ndarray:
    """Moves a register over 2**k zero bytes."""
    while len(_SHIFTS) <= k:
        if _SHIFTS:
            _SHIFTS.append(np.stack([_moved(_SHIFTS[-1], t) for t in _SHIFTS[-1]]))
        else:
            byte = np.arange(256, dtype=np.uint32)
            _SHIFTS.append(np.stack([_TABLE, *[byte << np.uint32(8 * j) for j in range(3)]]))
    return _SHIFTS[k]


def crc32c(data: bytes) -> int:
    """Registers of single bytes, combined pair by pair: the left one moves over the right one's bytes."""
    n = len(data)
    levels = max(0, n - 1).bit_length()
    c = np.zeros(1 << levels, np.uint32)  # zero bytes in front leave a zero register as it is
    if n:
        c[len(c) - n :] = _TABLE[np.frombuffer(data, np.uint8)]
    for k in range(levels):
        c = _moved(_shift(k), c[0::2]) ^ c[1::2]
    start = np.array([0xFFFFFFFF], np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            start = _moved(_shift(k), start)
    return int(c[0] ^ start[0]) ^ 0xFFFFFFFF


def shuffle(data: bytes, size: int) -> bytes:
    """Byte b of element e goes to b * n + e; bytes after the last whole element stay."""
    n = len(data) // size
    whole = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return whole.T.tobytes() + data[n * size :]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size
    whole = np.frombuffer(data, np.uint8, n * size).reshape(size, n)
    return whole.T.tobytes() + data[n * size :]


def bit_shuffle(data: bytes, size: int) -> bytes:
    """One plane of bits after another; only groups of eight elements take part."""
    n = len(data) // size // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(n, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def bit_unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size // 8 * 8
    if not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def blosc_encode(data: bytes, size: int, block: int = 1 << 16, bits: bool = False) -> bytes:
    flags = NO_SPLIT | ZSTD_FORMAT | (BIT_SHUFFLE if bits else BYTE_SHUFFLE if size > 1 else 0)
    mix = bit_shuffle if bits else shuffle if size > 1 else lambda x, _: x
    zstd, starts, body = zstandard.ZstdCompressor(level=3), [], b""
    block = max(1, min(block, len(data)))
    count = -(-len(data) // block)
    for k in range(count):
        own = mix(data[k * block : (k + 1) * block], size)
        packed = zstd.compress(own)
        packed = own if len(packed) >= len(own) else packed
        starts.append(16 + 4 * count + len(body))
        body += struct.pack("<I", len(packed)) + packed
    head = 16 + 4 * count
    if head + len(body) >= 16 + len(data):
        return struct.pack("<BBBBIII", 2, 1, flags | RAW, size, len(data), block, 16 + len(data)) + data
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, head + len(body)) + struct.pack(f"<{count}I", *starts) + body


def blosc_header(data: bytes) -> tuple[int, int, int, int, int]:
    """Flags, element size, bytes, block size and compressed bytes."""
    if len(data) < 16:
        raise DecodeError("a blosc chunk has a header of 16 bytes")
    _, _, flags, size, nbytes, block, packed = struct.unpack_from("<BBBBIII", data)
    if not block or nbytes > 16 << 20 or not 1 <= size <= 8:
        raise DecodeError("a blosc header is out of range")
    return flags, size, nbytes, block, packed


def blosc_blocks(data: bytes) -> list[tuple[int, int]]:
    """Place of each block's size in the chunk, and the block's bytes once decoded; the last block may be short. None for a raw chunk."""
    flags, _, nbytes, block, packed = blosc_header(data)
    if packed != len(data):
        raise DecodeError("a blosc chunk has another length than its header says")
    if flags & RAW:
        return []
    if flags >> 5 != ZSTD_FORMAT >> 5 or not flags & NO_SPLIT:
        raise DecodeError("only unsplit zstd blocks are supported")
    count = -(-nbytes // block)
    if len(data) < 16 + 4 * count:
        raise DecodeError("a blosc chunk is shorter than its table of blocks")
    starts = struct.unpack_from(f"<{count}I", data, 16)
    if any(not 16 + 4 * count <= at <= len(data) - 4 for at in starts):
        raise DecodeError("a blosc block starts outside its chunk")
    return [(at, min(block, nbytes - k * block)) for k, at in enumerate(starts)]


def blosc_decode(data: bytes) -> bytes:
    """A short last block is unshuffled by its own length, and is raw if it is stored in that length."""
    flags, size, nbytes, _, packed = blosc_header(data)
    blocks = blosc_blocks(data)
    if flags & RAW:
        return data[packed - nbytes :]
    zstd, out = zstandard.ZstdDecompressor(), []
    for at, own in blocks:
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise DecodeError("a blosc block ends outside its chunk")
        body = data[at + 4 : at + 4 + n]
        plain = body if n == own else zstd.decompress(body, max_output_size=own)
        out.append(bit_unshuffle(plain, size) if flags & BIT_SHUFFLE else unshuffle(plain, size) if flags & BYTE_SHUFFLE else plain)
    return b"".join(out)


def encode(data: bytes, codec: str, size: int) -> bytes:
    if codec == "none":
        return data
    return zstandard.ZstdCompressor(level=3).compress(data) if codec == "zstd" else blosc_encode(data, size)


def decode(data: bytes, codec: str, nbytes: int) -> bytes:
    """A chunk's bytes; DecodeError unless there are exactly ``nbytes``."""
    try:
        plain = data if codec == "none" else zstandard.ZstdDecompressor().decompress(data, max_output_size=nbytes) if codec == "zstd" else blosc_decode(data)
    except zstandard.ZstdError as e:
        raise DecodeError(str(e)) from e
    if len(plain) != nbytes:
        raise DecodeError(f"a chunk has {len(plain)} bytes where {nbytes} belong")
    return plain


def to_bfloat16(x: np.ndarray) -> np.ndarray:
    """float32 values rounded to the nearest bfloat16, ties to even; NaN stays NaN."""
    bits = x.astype(np.float32).view(np.uint32)
    rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(x), np.float32("nan"), rounded.view(np.float32))
