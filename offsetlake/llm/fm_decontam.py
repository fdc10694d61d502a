"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.blocks import ALNUM_WORDS, Block, blocks, release
from offsetlake.llm.scratch import fresh, materialise

SHARD_BYTES = 4 << 20
BLOCK_ITEM_BYTES = 8 << 20


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a sequence; one bit vector with running counts for each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in reversed(range(bits)):
            bit = (now >> level & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        start = np.zeros_like(end)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = (symbol >> level & 1).astype(bool)
            a, b = ones[start], ones[end]
            start, end = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at, its occurrences before at)."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[start], ones[at]
            bit = ones[at + 1] > b
            symbol = symbol << 1 | bit
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends first is smaller."""
    n = len(symbols)
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = (rank + 1) * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([False], sorted_key[1:] != sorted_key[:-1])))
        if n == 0 or new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search over a sequence of symbols 0..2**bits - 1, with suffix positions sampled every `every` places."""

    def __init__(self, symbols: np.ndarray, bits: int, every: int = 16):
        text = np.append(symbols + 1, 0)  # 0 ends the text
        order = suffix_array(text)
        self.tree = WaveletMatrix(text[order - 1], bits + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=(1 << bits) + 1))))
        marked = order % every == 0
        self.marked, self.samples, self.size = np.concatenate(([0], np.cumsum(marked))), order[marked], len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases (one a row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column] + 1
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            gone = low[alive] >= high[alive]
            high[alive[gone]] = low[alive[gone]]
            alive = alive[~gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: step back by LF until a sampled row."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            now = rows[todo]
            hit = self.marked[now + 1] > self.marked[now]
            out[todo[hit]] = self.samples[self.marked[now[hit]]] + steps
            todo, now = todo[~hit], now[~hit]
            symbol, rank = self.tree.access(now)
            rows[todo] = self.before[symbol] + rank
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items as rows of word numbers, by length, and the items of each window."""

    def __init__(self, items: list[tuple[int | str, bytes]], width: int):
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        ids = np.array([place[i] for i, _ in items], np.int64)
        parts = [(b.hashes(), b.first, b.rows.start) for b in blocks(pa.array([t for _, t in items], pa.large_binary()), ALNUM_WORDS, fold=True)]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _, _ in parts)]))
        rows: dict[int, dict[bytes, set[int]]] = {}
        for hashes, first, base in parts:
            numbers = np.searchsorted(self.words, hashes)
            for d in range(len(first) - 1):
                own = numbers[first[d] : first[d + 1]]
                size = min(width, len(own))
                for k in range(len(own) - size + 1 if size else 0):
                    rows.setdefault(size, {}).setdefault(own[k : k + size].tobytes(), set()).add(int(ids[base + d]))
        self.by_size = []
        for size, found in sorted(rows.items()):
            owners = [sorted(x) for x in found.values()]
            self.by_size.append((np.frombuffer(b"".join(found), np.int64).reshape(-1, size), np.concatenate(([0], np.cumsum([len(x) for x in owners]))), np.concatenate([np.array(x, np.int64) for x in owners])))
        self.shortest = min(rows, default=1)
        self.bits = max(1, int(len(self.words)).bit_length())

    def spans(self, block: Block) -> tuple[np.ndarray, list[set[int | str]]]:
        """Which words of the block are inside occurrences, and the items found in each document.

        The shard's index holds the runs of words that the phrases have, at least as long as the shortest phrase: nothing
        else can hold an occurrence. Runs end at a word that no phrase has and at a document's end.
        """
        hashes = block.hashes()
        found: list[set[int | str]] = [set() for _ in range(block.documents)]
        if not len(self.words) or not len(hashes):
            return np.zeros(len(hashes), bool), found
        number = np.searchsorted(self.words, hashes)
        number[number == len(self.words)] = 0
        known = self.words[number] == hashes
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        inner = block.first[(block.first > 0) & (block.first < len(known))]
        begins[inner], ends[inner - 1] = known[inner], known[inner - 1]
        low, high = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = high - low >= self.shortest
        low, high = low[long], high[long]
        edge = np.zeros(len(hashes) + 1, np.int64)
        if not len(low):
            return edge[:-1] > 0, found
        size = high - low + 1  # and a separator, which no phrase has
        start = np.cumsum(size) - size
        word = np.arange(size.sum()) - np.repeat(start - low, size)
        symbols = np.where(np.repeat(high, size) == word, len(self.words), number[np.minimum(word, len(number) - 1)])
        index = FMIndex(symbols, self.bits)
        for phrases, cut, owners in self.by_size:
            first, last = index.search(phrases)
            hits = np.flatnonzero(last > first)
            if not len(hits):
                continue
            count = (last - first)[hits]
            rows = np.arange(count.sum()) + np.repeat(first[hits] - (np.cumsum(count) - count), count)
            at = word[index.locate(rows)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + phrases.shape[1], -1)
            document = np.searchsorted(block.first, at, side="right") - 1
            for d, w in np.unique(np.stack((document, np.repeat(hits, count))), axis=1).T.tolist():
                found[d].update(self.ids[k] for k in owners[cut[w] : cut[w + 1]].tolist())
        return np.cumsum(edge[:-1]) > 0, found


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, kind: T.DataType) -> Iterator[list[tuple[int | str, bytes]]]:
    """Items in blocks of about BLOCK_ITEM_BYTES, so what is broadcast at once is bounded whatever the benchmark's size."""
    now, size = [], 0
    chosen = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in chosen.select(F.col(item_col).cast(kind), F.col(text_col).cast("string")).toLocalIterator():
        now.append((item, text.encode()))
        size += len(now[-1][1])
        if size >= BLOCK_ITEM_BYTES:
            yield now
            now, size = [], 0
    if now:
        yield now


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Find benchmark passages in every document and remove them.

    Words are maximal runs of 0-9, A-Z (folded), a-z and bytes above 0x7F. A phrase is `width` consecutive words of an item, or
    all words of an item with fewer. All columns of `docs` stay; added are n_words, n_hit (words inside an occurrence), hit_spans (array of first and
    last word, merged) and hit_items (sorted distinct item ids, strings if item_col has strings, else long); with_text also adds clean_text, the text without the bytes from each span's
    first word to its last. The names of added columns get underscores if docs has them; they are always the last columns, in this order.

    Defined results: null text has no words, no hits and stays null; items without id or words find nothing; equal items share phrases and are all
    reported; repeated rows are judged each; an empty benchmark hits nothing. A document's whole text is in one shard.
    A benchmark beyond BLOCK_ITEM_BYTES is searched block by block, and each block adds to the spans found before.
    """
    spark, out = docs.sparkSession, docs
    names = [fresh(n, docs.columns) for n in ("n_words", "n_hit", "hit_spans", "hit_items", "clean_text")]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    item = T.StringType() if isinstance(benchmark.schema[item_col].dataType, T.StringType) else T.LongType()
    arrow_item = pa.string() if isinstance(item, T.StringType) else pa.int64()
    kinds = [T.LongType(), T.LongType(), T.ArrayType(span), T.ArrayType(item), T.StringType()]
    added = [T.StructField(n, k) for n, k in zip(names[: 4 + with_text], kinds, strict=False)]
    schema = T.StructType([*docs.schema.fields, *added])
    place = docs.columns.index(text_col)
    width_in = len(docs.columns)
    packs = _item_blocks(benchmark, item_col, item_text_col, item)
    pack = next(packs, [])
    later = False
    while True:
        phrases = spark.sparkContext.broadcast(Phrases(pack, width))

        def scan(batches: Iterator[pa.RecordBatch], phrases=phrases, later=later) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_hit, spans, items, clean = [], [], [], [], []
                earlier = batch.column(width_in + 2).to_pylist() if later else None
                before = batch.column(width_in + 3).to_pylist() if later else None
                for block in blocks(batch.column(place), ALNUM_WORDS, True, SHARD_BYTES):
                    inside, found = phrases.value.spans(block)
                    for d in range(block.documents):
                        low, high = int(block.first[d]), int(block.first[d + 1])
                        row = block.rows.start + d
                        own = inside[low:high]
                        if later and earlier[row]:
                            own = own.copy()
                            for s in earlier[row]:
                                own[s["first"] : s["last"] + 1] = True
                            found[d].update(before[row])
                        n_words.append(high - low)
                        hits = int(own.sum())
                        n_hit.append(hits)
                        items.append(sorted(found[d]))
                        raw = block.data[block.offsets[d] : block.offsets[d + 1]]
                        if not hits:
                            spans.append([])
                            clean.append(None if block.null[d] else raw.tobytes())
                            continue
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                        pairs = [(int(a), int(b) - 1) for a, b in zip(turn[::2], turn[1::2], strict=True)]
                        spans.append([{"first": a, "last": b} for a, b in pairs])
                        keep = np.ones(len(raw), bool)
                        for a, b in pairs:
                            keep[block.start[low + a] - block.offsets[d] : block.end[low + b] - block.offsets[d]] = False
                        clean.append(raw[keep].tobytes())
                made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(arrow_item))]
                if with_text:
                    made.append(pa.array(clean, pa.binary()).cast(pa.string()))
                kept = batch.columns[:width_in]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])
                made = clean = spans = items = inside = found = block = own = keep = None
                release()

        out = out.mapInArrow(scan, schema)
        pack = next(packs, None)
        if pack is None:
            return out
        out, later = materialise(out, "searched"), True
