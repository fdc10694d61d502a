"""Language ID: averaged hashed subword embeddings, a linear softmax trained by SGD in numpy, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.blocks import blocks
from offsetlake.llm.fitting import fit_in_task
from offsetlake.llm.scratch import fresh

BUCKET_BITS = 16
SIZES = (2, 3, 4)
_U = np.uint32
_NONE = 1 << BUCKET_BITS  # the bucket of no subword

#: Letters' bytes, A-Z folded; every other byte becomes a blank. Bytes above 0x7F count as letters.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ANY = np.ones(256, bool)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the bucket of the byte n-gram at every byte: within a word, or one end on a word's edge; else none."""
    text = _LETTERS[data]
    blank = text == 32
    n = len(text)
    for size in SIZES:
        key = np.zeros(n, _U)
        if n < size:
            yield np.full(n, _NONE, np.int32)
            continue
        m = n - size + 1
        good = np.zeros(n, bool)
        good[:m] = True
        for i in range(size):
            key[:m] |= text[i : i + m].astype(_U) << _U(8 * i)
            if 0 < i < size - 1:
                good[:m] &= ~blank[i : i + m]
        good[:m] &= ~(blank[:m] & blank[size - 1 : size - 1 + m])
        for back in range(1, size):  # not across two documents
            edge = offsets[1:-1] - back
            good[edge[edge >= 0]] = False
        bucket = (key * _U(0x9E3779B1) + _U(0x85EBCA6B * size & 0xFFFFFFFF)) >> _U(0)
        bucket = (bucket ^ (bucket >> _U(15))) * _U(0x2C1B3C6D) >> _U(32 - BUCKET_BITS)
        yield np.where(good, bucket.astype(np.int32), _NONE)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (languages, buckets + 1): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Calibrated class probabilities of each text, from all of its subwords."""
        out = np.empty((len(column), len(self.languages)))
        for b in blocks(column, _ANY, False):
            total, count = np.zeros((b.documents, len(self.languages))), np.zeros(b.documents)
            held = np.flatnonzero(np.diff(b.offsets))
            for bucket in subwords(b.data, b.offsets) if len(held) else ():
                count[held] += np.add.reduceat((bucket != _NONE).astype(np.int64), b.offsets[held])
                for k in range(len(self.languages)):
                    total[held, k] += np.add.reduceat(self.scores[k][bucket], b.offsets[held])
            logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            logits -= logits.max(1, keepdims=True)
            out[b.rows] = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        return out


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id, from which nothing is learned either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(texts: list[bytes], labels: list[str], dimension: int = 16, epochs: int = 6, seed: int = 7, reject: float = 0.002) -> LanguageModel:
    """SGD over documents; a fifth of them is held back to set the temperature and the rejection threshold."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, _NONE + 1)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    rows = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        bucket = np.concatenate([*subwords(data, np.array([0, len(data)]))])
        rows.append(np.unique(bucket[bucket != _NONE], return_counts=True))
    target = np.array([languages.index(x) for x in labels])
    embed, weight, bias = rng.normal(0, 0.1, (_NONE + 1, dimension)), rng.normal(0, 0.3, (dimension, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(rows))
    fit, rest = order[: max(1, len(order) * 4 // 5)], order[max(1, len(order) * 4 // 5) :]
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            at, n = rows[i]
            if not len(at):
                continue
            share = (n / n.sum())[:, None]
            mean = (embed[at] * share).sum(0)
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            embed[at] -= rate * len(at) ** 0.5 * share * back
    scores = np.ascontiguousarray((embed @ weight).T)
    scores[:, _NONE] = 0
    model = LanguageModel(languages, scores, bias, 1.0, 0.0)
    rest = rest if len(rest) else fit
    logits = np.array([scores[:, rows[i][0]] @ (rows[i][1] / max(1, rows[i][1].sum())) + bias for i in rest])

    def chances(t: float) -> np.ndarray:
        z = logits / t
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    model.temperature = float(min(np.geomspace(0.05, 10, 60), key=lambda t: -np.log(chances(t)[np.arange(len(rest)), target[rest]] + 1e-12).mean()))
    model.threshold = float(min(0.5, np.quantile(chances(model.temperature).max(1), reject)))
    return model


def fit_languages(docs: DataFrame, max_rows: int = 3000, max_row_bytes: int = 16384, max_languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample of labelled rows: about max_rows, equally many of each language, texts up to max_row_bytes.

    The sample is taken by a hash of the id, so it is the same whatever the partitions. Rows with a null id, text or lang, and held-out rows
    (see held_out), are not used. More than max_languages labels raise an error. One task fits.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = usable.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return train([], [])
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col).cast("string") == r["lang"], F.lit(max_rows / len(counts) / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 40))
    chosen = usable.where((draw < share * float(1 << 40)) & (F.octet_length(text_col) <= max_row_bytes))
    rows = chosen.select(draw.alias("draw"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def fit(table: pa.Table) -> LanguageModel:
        return train([t.encode() for t in table["text"].to_pylist()], table["lang"].to_pylist())

    return fit_in_task(rows.orderBy("draw", "text", "lang").limit(2 * max_rows), ["draw", "text", "lang"], fit) or train([], [])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns, then lang_pred, lang_score and lang_rejected (with underscores where docs has such names; always the last three).

    Defined results: null texts, texts without a letter, and any text when nothing was learned give `und`, score 0, rejected. Every text gets
    the likeliest language and its calibrated probability; below the model's threshold it is rejected. Whole texts are read.
    """
    names = [fresh(n, docs.columns) for n in ("lang_pred", "lang_score", "lang_rejected")]
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.languages:
                p = m.probabilities(batch.column(place))
                best = p.argmax(1)
                added = [pa.array([m.languages[k] for k in best.tolist()], pa.string()), pa.array(p[np.arange(len(p)), best])]
            else:
                added = [pa.nulls(batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    out = docs.mapInArrow(score, schema)
    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.col(names[0]).isNotNull()
    lang, value = F.when(known, F.col(names[0])).otherwise("und"), F.when(known, F.col(names[1])).otherwise(0.0)
    return out.withColumns({names[0]: lang, names[1]: value, names[2]: ~known | (F.col(names[1]) < model.threshold)})
