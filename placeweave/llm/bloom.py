"""Bloom filters over hashes, built by Spark, of bounded size.

A filter is cut into blocks of ``BLOCK`` bits; a 64-bit hash names its block
and ``PROBES`` bits in it.  Tasks send the bits of their hashes packed by
block, each block is put together by one task, and the finished blocks (at
most ``MAX_BITS`` bits in all, whatever the data) go to every worker.

The number of bits follows the number of hashes up to that bound.  Beyond it a
filter only says "perhaps" more often: the operators take it as a hint of what
need not be shuffled and settle everything exactly behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from placeweave.llm.common import mix64
from placeweave.llm.packed import pack, split, unpack

BLOCK_BITS = 20
BLOCK = 1 << BLOCK_BITS
PROBES = 2
#: Bits for each hash, and the bound of a filter: 64 MB.
BITS_PER_HASH, MAX_BITS = 16, 1 << 29
#: Hashes that a task holds before it packs their bits.
HELD = 1 << 20
SEEN = "block int, data binary"
_SEEN = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def blocks_for(hashes: int) -> int:
    """So many blocks that a hash has about ``BITS_PER_HASH`` bits, as far as
    the bound goes (a power of two)."""
    bits = min(max(hashes * BITS_PER_HASH, BLOCK), MAX_BITS)
    return 1 << (bits // BLOCK - 1).bit_length()


def places(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each hash and its bits there."""
    m = mix64(h.astype(np.uint64))
    low = np.uint64(BLOCK - 1)
    bits = [((m >> np.uint64(BLOCK_BITS * i)) & low).astype(np.int32) for i in range(PROBES)]
    return ((m >> np.uint64(BLOCK_BITS * PROBES)) % np.uint64(n_blocks)).astype(np.int64), bits


def seen_batch(once: np.ndarray, again: np.ndarray, n_blocks: int) -> pa.RecordBatch:
    """The bits of hashes that a task has met (``once``) and of those that it
    met more than once (``again``), packed by block."""
    rows: dict[int, list[np.ndarray]] = {}
    for k, h in enumerate((once, again)):
        block, bits = places(h, n_blocks)
        for b, at in split(block, n_blocks):
            rows.setdefault(b, [np.empty(0, np.int32)] * 2)[k] = np.concatenate([x[at] for x in bits])
    data = [np.int64(len(x)).tobytes() + pack(np.concatenate([np.sort(x), np.sort(y)])) for x, y in rows.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(data, pa.binary())], schema=_SEEN)


class Pair:
    """The filters of once-seen and twice-seen hashes of one block."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)

    def meet(self, data: bytes) -> None:
        """The bits of one task: what is in ``once`` already is seen again."""
        n, bits = int(np.frombuffer(data, np.int64, 1)[0]), unpack(data[8:])[0]
        new, again = bits[:n], bits[n:]
        self.twice[new[self.once[new]]] = True
        self.twice[new[1:][new[1:] == new[:-1]]] = True      # two hashes on one bit
        self.twice[again] = True
        self.once[new] = True


def _put_together(twice: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pair = None, Pair()

        def done():
            bits = np.packbits(pair.twice if twice else pair.once).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(bits, 1)], pa.binary())], schema=_SEEN)

        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if b != at:
                    if at is not None:
                        yield done()
                    at, pair = b, Pair()
                pair.meet(data)
        if at is not None:
            yield done()
    return run


class Filter:
    """The finished blocks, for probing."""

    def __init__(self, blocks: dict[int, bytes], n_blocks: int) -> None:
        self.n_blocks = n_blocks
        self.bits = np.zeros((n_blocks, BLOCK // 8), np.uint8)
        for b, data in blocks.items():
            self.bits[b] = np.frombuffer(zstandard.decompress(data), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        block, bits = places(h, self.n_blocks)
        found = np.ones(len(h), bool)
        for at in bits:
            found &= (self.bits[block, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def collected(seen: DataFrame, twice: bool) -> dict[int, bytes]:
    """The twice-seen filter (else the once-seen one) of ``seen`` rows, by
    block, compressed: at most ``MAX_BITS`` bits."""
    merged = seen.repartition("block").sortWithinPartitions("block").mapInArrow(_put_together(twice), SEEN)
    return {r["block"]: bytes(r["data"]) for r in merged.toLocalIterator()}
