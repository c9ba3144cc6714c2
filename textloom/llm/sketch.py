"""Count-min sketches of items, one a partition, merged into two bits' worth of knowledge: counted twice or not.

Counters saturate at two, which is all that is asked of them.  A partition sends only the cells it touched; shards
of cells are merged one at a time; what goes to the driver and back is one bit a cell, a fixed size.  Too small a
sketch makes more items look repeated, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .windows import mix

DEPTH, SHARD_BITS = 2, 6
#: Cells of a row as a power of two: four for each expected item, between these bounds (2**30 cells: 128 MB a row).
#: Beyond some 270 million items rows fill up: more single items pass, and the exact stage behind has more to group.
FEWEST_BITS, MOST_BITS = 18, 30
#: Items gathered before a partition sends what it has.
FLUSH = 1_000_000


def width_for(items: float) -> int:
    return int(min(MOST_BITS, max(FEWEST_BITS, np.ceil(np.log2(4 * max(items, 1))))))


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    salt = np.uint64(0xD6E8FEB86659FD93 * (2 * row + 1) % 2**64)
    return (mix(items ^ salt) >> np.uint64(64 - bits)).astype(np.int64)


def _sent(items: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    shards, ones, twos = [], [], []
    low = bits - SHARD_BITS
    for row in range(DEPTH):
        found, counts = np.unique(cells(items, row, bits), return_counts=True)
        edges = np.searchsorted(found, np.arange(2**SHARD_BITS + 1) << low)
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own, many = (found[a:b] & (2**low - 1)).astype(np.uint32), counts[a:b] > 1
            if len(own):
                shards.append(row * 2**SHARD_BITS + s)
                ones.append(own[~many].tobytes())
                twos.append(own[many].tobytes())
    yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "ones": pa.array(ones, pa.binary()), "twos": pa.array(twos, pa.binary())})


def sketch_repeated(source: DataFrame, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """The merged sketch of all items of `source`, as packed bits: cells counted twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for found in items(batch):
                waiting.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield from _sent(np.concatenate(waiting), bits)
                    waiting, n = [], 0
        if n:
            yield from _sent(np.concatenate(waiting), bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, counts = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "many": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

        for batch in batches:
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if shard is not None:
                        yield out()
                    shard, counts = s, np.zeros(2 ** (bits - SHARD_BITS), np.uint8)
                at = np.frombuffer(one, np.uint32)  # distinct cells
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(two, np.uint32)] = 2
        if shard is not None:
            yield out()

    sent = source.mapInArrow(count, "shard int, ones binary, twos binary")
    merged = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, many binary")
    whole = np.zeros((DEPTH * 2**SHARD_BITS, 2 ** (bits - SHARD_BITS) // 8), np.uint8)
    for r in merged.collect():  # DEPTH * 2**bits / 8 bytes
        whole[r["shard"]] = np.frombuffer(r["many"], np.uint8)
    return source.sparkSession.sparkContext.broadcast(whole.reshape(DEPTH, -1))


def may_repeat(sketch: np.ndarray, items: np.ndarray, bits: int) -> np.ndarray:
    """True for each item that the sketch counts twice or more."""
    said = np.ones(len(items), bool)
    for row in range(DEPTH):
        at = cells(items, row, bits)
        said &= (sketch[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return said
