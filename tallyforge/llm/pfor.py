"""Patched frame-of-reference coding of token ids.

Ids are cut in blocks of BLOCK. A block stores its minimum, and each id's difference from it in `width` bits, where
the width is that of the block's 90th-percentile difference; the high bits of larger differences go to an exception
list (place in the block, rest of the value). A page holds the blocks of some whole documents and, in front, an index:
where each block starts, and how many ids each document has.

Page layout (little-endian): magic "PFR1"; uint32 documents, ids, blocks; int64 document ids; uint8 null flags;
uint32 ids per document; uint32 block starts (bytes from the first block); then the blocks: uint32 minimum, uint8
width, uint8 number of exceptions, packed differences, exception places (uint8 each), exception rests (uint32 each).
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PERCENTILE = 90
MAGIC = b"PFR1"


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Number of bits of each non-negative value below 2**32."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks and their bytes."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint32), b""
    count = -(-n // BLOCK)
    padded = np.empty(count * BLOCK, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1]  # the last block is filled up with its last id; the index says how many are real
    grid = padded.reshape(count, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    width = _bit_length(np.partition(diff, at, axis=1)[:, at])
    over = diff >= (np.int64(1) << width)[:, None]
    exceptions = over.sum(axis=1)
    sizes = 6 + width * (BLOCK // 8) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), np.uint8)
    heads = np.zeros((count, 6), np.uint8)
    heads[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    heads[:, 4], heads[:, 5] = width, exceptions
    out[starts[:-1, None] + np.arange(6)] = heads
    for w in np.unique(width[width > 0]):  # all blocks of one width at once
        own = np.flatnonzero(width == w)
        bytes_of = (diff[own] & ((1 << int(w)) - 1)).astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4)
        bits = np.unpackbits(bytes_of, axis=2, bitorder="little", count=int(w)).reshape(len(own), BLOCK * int(w))
        out[starts[own, None] + 6 + np.arange(int(w) * BLOCK // 8)] = np.packbits(bits, axis=1, bitorder="little")
    block, place = np.nonzero(over)
    if len(block):
        rank = np.arange(len(block)) - np.concatenate([[0], np.cumsum(exceptions)])[block]
        base = starts[block] + 6 + width[block] * (BLOCK // 8)
        out[base + rank] = place
        rest = (diff[block, place] >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = rest
    return starts[:-1].astype(np.uint32), out.tobytes()


def decode_blocks(starts: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """The n ids of blocks that begin at starts."""
    if not n:
        return np.empty(0, np.uint32)
    raw, starts = np.frombuffer(data, np.uint8), starts.astype(np.int64)
    low = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.int64)
    width, exceptions = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        packed = raw[starts[own, None] + 6 + np.arange(int(w) * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, int(w))
        wide = np.zeros((len(bits), 32), np.uint8)
        wide[:, : int(w)] = bits
        out[own] = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(len(own), BLOCK)
    if exceptions.any():
        block = np.repeat(np.arange(len(starts)), exceptions)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = starts[block] + 6 + width[block] * (BLOCK // 8)
        place = raw[base + rank]
        rest = np.ascontiguousarray(raw[(base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0].astype(np.int64)
        out[block, place] |= rest << width[block]
    return (out + low[:, None]).reshape(-1)[:n].astype(np.uint32)


def write_page(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    head = np.array([len(doc_ids), len(ids), len(starts)], "<u4").tobytes()
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    nulls = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, keys, nulls, np.array(counts, "<u4").tobytes(), starts.astype("<u4").tobytes(), blocks])


def read_page(page: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a page."""
    if page[:4] != MAGIC:
        raise ValueError("not a page of token ids")
    d, n, b = (int(x) for x in np.frombuffer(page, "<u4", 3, 4))
    at = 16
    keys = np.frombuffer(page, "<i8", d, at)
    nulls = np.frombuffer(page, np.uint8, d, at + 8 * d)
    counts = np.frombuffer(page, "<u4", d, at + 9 * d)
    starts = np.frombuffer(page, "<u4", b, at + 13 * d)
    ids = decode_blocks(starts, page[at + 13 * d + 4 * b :], n)
    return [None if z else int(k) for k, z in zip(keys, nulls)], counts.astype(np.int64), ids
