"""Which keys occur in more than one place: chunks of whole documents, and a tree that merges what the chunks have.

A chunk is a row that holds about ``CHUNK_BYTES`` of whole documents, cut from the table in the order of its rows, so that neither null ids nor
repeated rows gather anywhere. Chunks send their items, sorted by key and cut by ranges of the key; routers merge them and return
to each chunk what the merged ranges say of its items. A router takes one range from 2**bits chunks, bits being FAN_BITS at most. If there are more
chunks than that, it sends what it merged on to routers of narrower ranges, as a chunk of the next level would. So a chunk and a router
send at most 2**FAN_BITS blobs a level, a router holds about one chunk's items, and the number of blobs grows with the number of chunks,
times the levels (one up to 256 chunks, two up to 65,536, three beyond). Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.blocks import mix, release
from offsetlake.llm.scratch import materialise

CHUNK_BYTES = 8 << 20
ROW_BYTES = 16  # what a row counts for besides its text
FAN_BITS = 8
_U = np.uint64
_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()

#: Items of some keys: the sorted keys, and other columns of equal length.
Items = tuple[np.ndarray, ...]


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    return _PACK.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array of unsigned integers as compressed differences."""
    steps = np.diff(values.astype(np.uint64), prepend=_U(0))
    top = int(steps.max()) if len(steps) else 0
    for code, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32)):
        if top < 1 << 8 * code:
            return bytes([code]) + _PACK.compress(steps.astype(kind).tobytes())
    return bytes([8]) + pack(steps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    if blob[0] == 8:
        return np.cumsum(unpack(blob[1:]), dtype=np.uint64)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]]
    return np.cumsum(np.frombuffer(_UNPACK.decompress(blob[1:]), kind), dtype=np.uint64)


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


_CHUNK = pa.schema([("chunk", pa.int64()), ("rows", pa.binary())])


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, rows): whole documents (doc_id, text) of about CHUNK_BYTES a chunk, to be read with `documents`.

    Chunks are cut in the order of the rows, so a repeated task must see the same order: rows that come out of a shuffle are written to the shared folder first.
    """

    limit = CHUNK_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, size, chunk
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            held, size, chunk = [], 0, chunk + 1
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_CHUNK)

        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
            low = 0
            while low < batch.num_rows:
                before = int(total[low - 1]) if low else 0
                high = min(batch.num_rows, int(np.searchsorted(total, before + limit - size)) + 1)
                held.append(batch.slice(low, high - low))
                size += int(total[high - 1]) - before
                low = high
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialise(rows, "rows")
    return rows.mapInArrow(cut, "chunk long, rows binary")


def documents(chunk: pa.Table) -> pa.Table:
    """The documents (doc_id, text) of a group of one chunk."""
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(r.as_py())).read_all() for r in chunk["rows"]]).combine_chunks()


def levels(ranges: int) -> list[int]:
    """Bits of the key that each level of the tree cuts by, for at least `ranges` ranges at the last."""
    bits = max(1, (max(1, ranges) - 1).bit_length())
    n = -(-bits // FAN_BITS)
    return [bits * (i + 1) // n - bits * i // n for i in range(n)]


_PART = pa.schema([("group", pa.int64()), ("path", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
_TOLD = pa.schema([("node", pa.int64()), ("path", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])


@dataclass(frozen=True)
class Tree:
    """Ranges of keys of `bits` bits, cut by the bits of each level; `merge` and the rest say what is done with the items of a range.

    merge: several nodes' items in one. top: what the merged items of all chunks say. down: the same, from a group's merged items and what came
    from above. answer: what a node is told of its own items. A path is a table number, then the key's leading bits.
    """

    bits: int
    cuts: tuple[int, ...]
    chunks: int
    merge: Callable[[list[Items]], Items]
    top: Callable[[Items], Items]
    down: Callable[[Items, Items], Items]
    answer: Callable[[Items, Items], Items]

    def _base(self, path: int, done: int) -> np.uint64:
        return _U((path & ((1 << done) - 1)) << (self.bits - done))

    def _group(self, node: int, level: int) -> int:
        if level == len(self.cuts) - 1:
            return 0
        groups = -(-self.chunks // (1 << sum(self.cuts[: level + 1])))
        return int(mix(np.array([node], np.uint64))[0] % _U(groups))

    def _pack(self, items: Items, path: int, done: int) -> tuple[bytes, bytes]:
        return pack_sorted(items[0] - self._base(path, done)), b"".join(len(b).to_bytes(4, "little") + b for b in map(pack, items[1:]))

    def unpack(self, keys: bytes, more: bytes, path: int, level: int) -> Items:
        out, at = [unpack_sorted(keys) + self._base(path, sum(self.cuts[: level + 1]))], 0
        while at < len(more):
            end = at + 4 + int.from_bytes(more[at : at + 4], "little")
            out.append(unpack(more[at + 4 : end]))
            at = end
        return tuple(out)

    def parts(self, items: Items, path: int, node: int, level: int) -> list[tuple]:
        """Rows of _PART of a node's items in the range `path`, cut by the level's ranges."""
        cut, done = self.cuts[level], sum(self.cuts[: level + 1])
        edges = np.searchsorted(items[0] >> _U(self.bits - done), np.arange((1 << cut) + 1, dtype=np.uint64) + _U((path & ((1 << done - cut) - 1)) << cut))
        group, out = self._group(node, level), []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = path << cut | k
            out.append((group, own, node, *self._pack(tuple(x[edges[k] : edges[k + 1]] for x in items), own, done)))
        return out

    def table(self, rows: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def _own(self, table: pa.Table, level: int) -> tuple[int, list[int], list[Items]]:
        path = table["path"][0].as_py()
        return path, table["node"].to_pylist(), [self.unpack(k, m, path, level) for k, m in zip(table["keys"].to_pylist(), table["more"].to_pylist(), strict=True)]

    def _tell(self, path: int, nodes: list[int], own: list[Items], settled: Items, level: int) -> pa.Table:
        rows = [(n, path, *self._pack(told, path, sum(self.cuts[: level + 1]))) for n, told in ((n, self.answer(o, settled)) for n, o in zip(nodes, own, strict=True)) if len(told[0])]
        release()
        return self.table(rows, _TOLD)

    def replies(self, parts: DataFrame, level: int = 0) -> DataFrame:
        """(node, path, keys, more) told to the nodes that sent the parts."""
        ranges = parts.groupBy("group", "path")
        told_schema, part_schema = "node long, path long, keys binary, more binary", "group long, path long, node long, keys binary, more binary"
        if level == len(self.cuts) - 1:

            def settle(table: pa.Table) -> pa.Table:
                path, nodes, own = self._own(table, level)
                return self._tell(path, nodes, own, self.top(self.merge(own)), level)

            return ranges.applyInArrow(settle, told_schema)

        def rise(table: pa.Table) -> pa.Table:
            path, _, own = self._own(table, level)
            out = self.table(self.parts(self.merge(own), path, table["group"][0].as_py(), level + 1), _PART)
            release()
            return out

        def fall(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows:
                return self.table([], _TOLD)
            path, nodes, own = self._own(table, level)
            merged = self.merge(own)
            above = sorted((p, self.unpack(k, m, p, level + 1)) for p, k, m in zip(told["sub"].to_pylist(), told["keys"].to_pylist(), told["more"].to_pylist(), strict=True)) if told.num_rows else []
            joined = tuple(np.concatenate([x[:0], *(items[i] for _, items in above)]) for i, x in enumerate(merged))
            return self._tell(path, nodes, own, self.down(merged, joined), level)

        above = self.replies(ranges.applyInArrow(rise, part_schema), level + 1)
        above = above.select(F.col("node").alias("group"), F.shiftright("path", self.cuts[level + 1]).alias("path"), F.col("path").alias("sub"), "keys", "more")
        return ranges.cogroup(above.groupBy("group", "path")).applyInArrow(fall, told_schema)


def _twice(parts: list[Items]) -> Items:
    """All positions, each at most twice."""
    at = np.sort(np.concatenate([p[0] for p in parts]))
    return (at[np.concatenate((np.ones(min(2, len(at)), bool), at[2:] != at[:-2]))],)


def _repeated(merged: Items) -> Items:
    at = merged[0]
    return (np.unique(at[1:][at[1:] == at[:-1]]),)


def _held(own: Items, settled: Items) -> Items:
    return (np.unique(own[0][among(own[0], settled[0])]),)


@dataclass(frozen=True)
class CountMin:
    """`depth` rows of 2**bits counters, merged by a tree. A key is estimated repeated if all its counters reach two; estimates are never too low."""

    bits: int
    tree: Tree
    depth: int = 2

    @staticmethod
    def for_text(size: int, depth: int = 2) -> CountMin:
        """For keys at every word of `size` bytes of text, taken as a key for 5 bytes: four counters a key."""
        bits = max(16, (4 * max(1, size // 5)).bit_length())
        chunks = max(1, -(-size // CHUNK_BYTES))
        return CountMin(bits, Tree(bits, tuple(levels(chunks)), chunks, _twice, _repeated, lambda merged, told: told, _held), depth)

    def counters(self, keys: np.ndarray, row: int) -> np.ndarray:
        odd = _U((0xD6E8FEB86659FD93 + 0x5851F42D4C957F2E * row) % (1 << 64) | 1)
        return mix(keys * odd + _U(row)) >> _U(64 - self.bits)

    def parts(self, keys: np.ndarray, node: int) -> list[tuple]:
        """Rows of _PART: the positions of the keys, each at most twice, of each sketch row."""
        return [p for row in range(self.depth) for p in self.tree.parts(_twice([(self.counters(keys, row),)]), row, node, 0)]

    def repeated(self, keys: np.ndarray, told: pa.Table) -> np.ndarray:
        """Which keys all of whose counters reach two, by what the chunk was told."""
        mask = np.ones(len(keys), bool)
        rows = sorted(zip(told["path"].to_pylist(), told["keys"].to_pylist(), told["more"].to_pylist(), strict=True))
        for row in range(self.depth):
            full = [self.tree.unpack(k, m, p, 0)[0] for p, k, m in rows if p >> self.tree.cuts[0] == row]
            mask &= among(self.counters(keys, row), np.concatenate([np.zeros(0, np.uint64), *full]))
        return mask

    def exchange(self, chunks: DataFrame, keys: Callable[[pa.Table], np.ndarray]) -> DataFrame:
        """(chunk, path, keys, more): for each chunk, its counters that reach two in the merged sketch."""
        return self.tree.replies(self.sent(chunks, keys)).withColumnRenamed("node", "chunk")

    def sent(self, chunks: DataFrame, keys: Callable[[pa.Table], np.ndarray]) -> DataFrame:
        """What the chunks send to the first level: their partition sketches."""

        def part(table: pa.Table) -> pa.Table:
            out = self.tree.table(self.parts(keys(documents(table)), table["chunk"][0].as_py()), _PART)
            release()
            return out

        return chunks.groupBy("chunk").applyInArrow(part, "group long, path long, node long, keys binary, more binary")
