"""Quality rules: base rules on each text, and lines that too many documents of a host have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.blocks import SPACE_WORDS, blocks
from offsetlake.llm.scratch import fresh, materialise
from offsetlake.llm.skew import hot_join, hot_keys
from offsetlake.llm.textstats import Lines, per_document, repeated_window_words, repeats, symbols, word_characters

_SCHEMA = "doc_id long, row long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
_FIELDS = ["doc_id", "row", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the base counts, and for each distinct normalised line its hash and its words in all places."""
    for batch in batches:
        for b in blocks(batch.column("text"), SPACE_WORDS, fold=False):
            own = batch.slice(b.rows.start, b.documents)
            hashes = b.hashes()
            lines = Lines(b)
            _, again = repeats(lines.raw, lines.document)
            at_line = np.searchsorted(lines.document, np.arange(b.documents + 1))
            norm = lines.normalised(b)
            found, words = [], []
            for d in range(b.documents):
                low, high = at_line[d], at_line[d + 1]
                u, inverse = np.unique(norm[low:high], return_inverse=True)
                found.append(u.view(np.int64))
                words.append(np.bincount(inverse, (lines.last - lines.first)[low:high], len(u)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("row"), own.column("host"), pa.array(np.diff(b.first)), pa.array(word_characters(b)), pa.array(symbols(b)), pa.array(per_document(again, at_line)), pa.array(repeated_window_words(b, hashes)), pa.array(found, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=_FIELDS
            )


def line_quality(docs: DataFrame, min_docs: int = 20, share: float = 0.05, max_removed: float = 0.5, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each input row: doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words_removed, removed_lines, kept.

    A line is too frequent if more than max(min_docs, share * documents of the host) distinct documents of the host have
    it, compared by a hash of its words with A-Z folded. Its words are removed from every document of that host. A document is rejected (kept is
    false) if the base rules fail (n_words < 50, or 100 * n_repeat_words > 50 * n_words), or if it is depleted: more than max_removed of its words
    go, or fewer than min_words stay. `row` hashes id and text, and ties a row to `without_frequent_lines`.

    Defined results: null or blank texts have no words and lines, so the base rules fail; a null host is a host of its own;
    a row without id counts as a document of its own; rows with equal id and text are one document and get equal results.
    No rows for an empty table. Only the three named columns are read.
    """
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(key.alias("doc_id"), F.xxhash64(key, text).alias("row"), F.xxhash64(F.col(host_col)).alias("host"), text.alias("text"))
    measured = materialise(rows.mapInArrow(_measure, _SCHEMA), "measured")
    who = F.coalesce("doc_id", "row")
    places = measured.select("host", "row", who.alias("who"), F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "row", "who", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    sizes = measured.groupBy("host").agg(F.count_distinct(who).alias("documents"))
    often = materialise(places.groupBy("host", "line").agg(F.count_distinct("who").alias("in_documents"), F.count("*").alias("n")).where(F.col("in_documents") > min_docs), "often")
    by_host = hot_keys(often.groupBy("host").agg(F.count("*").alias("n")), "host")
    often = materialise(hot_join(often, sizes, ["host"], by_host).where(F.col("in_documents") > share * F.col("documents")).select("host", "line", "n"), "frequent")
    gone = hot_join(places, often.drop("n"), ["host", "line"], hot_keys(often, "host", "line"))
    gone = gone.dropDuplicates(["row", "host", "line"]).groupBy("row", "host").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("removed_lines"))
    out = measured.drop("lines", "line_words").join(gone, ["row", "host"], "left")
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    gone_words = F.coalesce("gone", F.lit(0).cast("long"))
    depleted = (gone_words > max_removed * F.col("n_words")) | (F.col("n_words") - gone_words < min_words)
    return out.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone_words.alias("n_line_words_removed"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"), (~failed & ~depleted).alias("kept"))


def without_frequent_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents, all columns, with the too frequent lines taken out of the text (the other lines stay as they are)."""
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    row, gone = fresh("row_", docs.columns), fresh("removed_", docs.columns)
    chosen = verdicts.where("kept").select(F.col("row").alias(row), F.col("removed_lines").alias(gone)).dropDuplicates([row])
    joined = docs.withColumn(row, F.xxhash64(key, text)).join(chosen, row)
    place, names = docs.columns.index(text_col), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.select([*names, gone])
            removed, texts = batch.column(gone).to_pylist(), []
            for b in blocks(batch.column(place), SPACE_WORDS, fold=False):
                lines = Lines(b)
                norm = lines.normalised(b).view(np.int64)
                cut = np.searchsorted(lines.document, np.arange(b.documents + 1))
                for d in range(b.documents):
                    raw, base = b.data[b.offsets[d] : b.offsets[d + 1]], b.offsets[d]
                    low, high = cut[d], cut[d + 1]
                    bad = np.isin(norm[low:high], removed[b.rows.start + d]) if removed[b.rows.start + d] else np.zeros(high - low, bool)
                    if bad.any():
                        keep = np.ones(len(raw), bool)
                        for k in (np.flatnonzero(bad) + low).tolist():
                            keep[lines.start[k] - base : lines.stop[k] - base + 1] = False
                        raw = raw[keep]
                    texts.append(None if b.null[d] else raw.tobytes())
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, gone).mapInArrow(clean, docs.schema)
