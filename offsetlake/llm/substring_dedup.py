"""Substring dedup: a count-min prefilter, then exact groups of the windows estimated repeated."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from offsetlake.llm.blocks import SPACE_WORDS, blocks, windows
from offsetlake.llm.repeats import _PART, CHUNK_BYTES, CountMin, Items, Tree, chunked, documents, levels
from offsetlake.llm.scratch import corpus_bytes

_NONE = np.iinfo(np.uint64).max
_SIGN = np.uint64(1 << 63)


def _owner(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned integers of the same order."""
    return ids.view(np.uint64) ^ _SIGN


def _windows(b, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, two hashes) of every window of a block: 128 bits in all."""
    one, two = b.digests()
    at, h = windows(one, b.first, width)
    return at, h, windows(two, b.first, width)[1]


def _chunk_windows(docs: pa.Table, width: int) -> Items:
    """(hash, second hash, owner) of every window of a chunk; rows without a doc_id have none."""
    ids = docs["doc_id"].combine_chunks()
    known, ids = np.asarray(ids.is_valid()), _owner(np.asarray(ids.fill_null(0)))
    found = [(np.zeros(0, np.uint64),) * 3]
    for b in blocks(docs["text"], SPACE_WORDS, fold=False):
        at, h, h2 = _windows(b, width)
        row = b.word_document()[at] + b.rows.start
        mine = known[row]
        found.append((h[mine], h2[mine], ids[row[mine]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(parts: list[Items]) -> Items:
    """Distinct (hash, second hash) in order, and the smallest owner of each."""
    h, h2, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(h):
        return h, h2, owner
    order = np.argsort(h, kind="stable")
    if ((h[order][1:] == h[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h))
    h, h2 = h[order], h2[order]
    starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))))
    return h[starts], h2[starts], np.minimum.reduceat(owner[order], starts)


def _find(own: Items, held: Items) -> np.ndarray:
    """The owner that `held` has for each (hash, second hash) of `own`, or _NONE."""
    out = np.full(len(own[0]), _NONE)
    if not len(held[0]):
        return out
    at = np.searchsorted(held[0], own[0])
    todo = np.arange(len(at))
    while len(todo):  # once, but for different windows with equal first hashes
        todo = todo[at[todo] < len(held[0])]
        todo = todo[held[0][at[todo]] == own[0][todo]]
        same = held[1][at[todo]] == own[1][todo]
        out[todo[same]] = held[2][at[todo[same]]]
        todo = todo[~same]
        at[todo] += 1
    return out


def _lower(own: Items, settled: Items) -> Items:
    """The own items that have a smaller owner elsewhere, with that owner."""
    best = _find(own, settled)
    low = best < own[2]
    return own[0][low], own[1][low], best[low]


def remove_repeated_substrings(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove words of windows that also start in a document with a smaller id.

    Words are runs of non-blank bytes, unchanged; windows are `width` consecutive words of one document and are judged
    on the input. Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) for each input row.

    Defined results: null or blank text has no words and keeps "". A row without id neither removes nor loses words.
    Rows with equal ids never remove each other's words. Texts of fewer than `width` words stay whole. An empty table gives
    no rows. Only the two named columns are read, so other columns cannot clash.

    The prefilter compares windows by 64-bit hashes, which can only let more of them through; those that it lets through are grouped by 128 bits.
    Texts are shuffled once, by chunk (Spark reuses that exchange for the three passes); sketches, groups and answers travel as compressed arrays in the
    tree of `repeats`, whose blobs grow in number with the chunks.
    """
    size = corpus_bytes(docs, text_col)
    chunks = chunked(docs, id_col, text_col)
    sketch = CountMin.for_text(size)
    owners = Tree(64, tuple(levels(-(-size // (2 * CHUNK_BYTES)))), sketch.tree.chunks, _least, lambda merged: merged, lambda merged, told: _least([merged, told]), _lower)
    told = sketch.exchange(chunks, lambda d: _chunk_windows(d, width)[0])

    def flagged(table: pa.Table, answer: pa.Table) -> pa.Table:
        own = _chunk_windows(documents(table), width)
        keep = sketch.repeated(own[0], answer)
        return owners.table(owners.parts(_least([tuple(x[keep] for x in own)]), 0, table["chunk"][0].as_py(), 0), _PART)

    exact = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(flagged, "group long, path long, node long, keys binary, more binary")
    answers = owners.replies(exact).withColumnRenamed("node", "chunk")
    result_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def removed(table: pa.Table, answer: pa.Table) -> pa.Table:
        docs = documents(table)
        there = [owners.unpack(k, m, p, 0) for p, k, m in sorted(zip(answer["path"].to_pylist(), answer["keys"].to_pylist(), answer["more"].to_pylist(), strict=True))]
        far = tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint64),) * 3, *there, strict=True))
        near = _least([_chunk_windows(docs, width)])
        column = docs["doc_id"].combine_chunks()
        known, ids = np.asarray(column.is_valid()), _owner(np.asarray(column.fill_null(0)))
        words, gone, texts = [], [], []
        for b in blocks(docs["text"], SPACE_WORDS, fold=False):
            at, *own = _windows(b, width)
            row = b.word_document()[at] + b.rows.start
            least = np.minimum(_find(own, near), _find(own, far))
            hit = at[(least < ids[row]) & known[row]]
            edge = np.zeros(len(b.start) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + width, -1)
            kept = np.cumsum(edge[:-1]) == 0
            for d in range(b.documents):
                low, high = int(b.first[d]), int(b.first[d + 1])
                own = kept[low:high]
                pieces = b.data[b.offsets[d] : b.offsets[d + 1]].tobytes().split()
                texts.append(b" ".join(pieces if own.all() else compress(pieces, own.tolist())))
                words.append(high - low)
                gone.append(high - low - int(own.sum()))
        kept_text = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table({"doc_id": column, "n_words": words, "n_removed": gone, "kept_text": kept_text}, schema=result_schema)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept_text string")
