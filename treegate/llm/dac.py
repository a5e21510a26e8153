"""Directly addressable codes for token ids: the file format, its writer and reader.

An id is cut into chunks of ``CHUNK`` bits, least significant first.  Level l holds the
l-th chunk of every id that has one; a continuation bitmap beside it says which of
them go on at level l + 1, and a rank directory (ones before each block of ``BLOCK``
bits) gives an id's place there.  Any token is so read with one chunk, one bit and one
rank per level, without decoding a block.

File: the magic, then a header of little-endian unsigned 64-bit numbers (documents,
tokens, levels), the documents' ids (signed 64-bit) and a byte each that is 0 where the
id is null, the documents' starts (documents + 1, unsigned 64-bit), then for each level
its number of chunks (unsigned 64-bit), the chunks (a byte each), the bitmap (least
significant bit first, padded to 8 bytes) and the directory (unsigned 32-bit, one a
block and one more).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TGDAC1\0\0"
CHUNK, BLOCK = 8, 512


def _directory(bits: np.ndarray) -> np.ndarray:
    pad = np.zeros(-len(bits) % BLOCK + len(bits), np.uint8)
    pad[: len(bits)] = bits
    out = np.zeros(len(pad) // BLOCK + 1, np.uint32)
    np.cumsum(pad.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32), out=out[1:])
    return out


def encode(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file from documents' ids, token counts and all their tokens (uint32)."""
    starts = np.zeros(len(lengths) + 1, np.uint64)
    np.cumsum(lengths, out=starts[1:])
    levels, rest = [], ids.astype(np.uint32)
    while True:
        high = rest >> np.uint32(CHUNK)
        more = high > 0
        bits = more.astype(np.uint8)
        packed = np.packbits(bits, bitorder="little").tobytes()
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + packed + b"\0" * (-len(packed) % 8) + _directory(bits).astype("<u4").tobytes())
        rest = high[more]
        if not len(rest):
            break
    head = struct.pack("<3Q", len(lengths), len(ids), len(levels))
    return b"".join([MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids), starts.astype("<u8").tobytes(), *levels])


class TokenFile:
    """A file as bytes (or a memory map): documents, single tokens, or everything."""

    def __init__(self, data):
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        documents, self.tokens, levels = struct.unpack_from("<3Q", data, at)
        at += 24
        ids = np.frombuffer(data, "<i8", documents, at)
        at += 8 * documents
        known = np.frombuffer(data, np.uint8, documents, at)
        at += documents
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.frombuffer(data, "<u8", documents + 1, at).astype(np.int64)
        at += 8 * (documents + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            packed = -(-n // 8)
            bitmap = np.frombuffer(data, np.uint8, packed, at)
            at += packed + -packed % 8
            blocks = -(-n // BLOCK) + 1
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return self.tokens

    def token(self, i: int) -> int:
        """Token i, by one chunk and one rank per level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            before = int(np.bitwise_count(bitmap[first:byte]).sum()) + int(bitmap[byte] & (1 << bit) - 1).bit_count()
            i, shift = int(directory[i // BLOCK]) + before, shift + CHUNK
        return value

    def document(self, d: int) -> np.ndarray:
        """The tokens of the d-th document, each by direct address."""
        return np.array([self.token(i) for i in range(self.starts[d], self.starts[d + 1])], np.uint32)

    def all(self) -> np.ndarray:
        """Every token, level by level from the last."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(CHUNK)
            out = here
        return out
