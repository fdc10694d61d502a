"""Quality classifier: a sparse ensemble of rules from tree paths, weighted by a lasso logistic fit, compiled to Spark columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.blocks import SPACE_WORDS, Block, blocks
from offsetlake.llm.langid import held_out
from offsetlake.llm.scratch import fresh
from offsetlake.llm.textstats import Lines, class_bytes, per_document, repeated_window_words, repeats, symbols, word_characters

#: Statistics of a whole text, in this order; shares are of bytes, words or lines.
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "high", "line_words", "repeated_lines", "distinct_words", "repeated_windows", "short_lines")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_MARK, _BANG, _HIGH = _table(b".,;:?'\"()-"), _table(b"!"), _table(bytes(range(128, 256)))


def statistics(block: Block) -> np.ndarray:
    """A row of STATISTICS for each document of a block of SPACE_WORDS words; a text without words has zeros (and its size)."""
    size, words = np.diff(block.offsets), np.diff(block.first)
    by = np.maximum(size, 1)
    hashes = block.hashes()
    lines = Lines(block)
    cut = np.searchsorted(lines.document, np.arange(block.documents + 1))
    n_lines = np.diff(cut)
    _, again_line = repeats(lines.raw, lines.document)
    _, again_word = repeats(hashes, block.word_document())
    n_words = np.maximum(words, 1)
    short = (lines.last - lines.first) < 4
    columns = [
        np.log1p(size), np.log1p(words), word_characters(block) / n_words, class_bytes(block, _UPPER) / by, class_bytes(block, _DIGIT) / by, class_bytes(block, _MARK) / by, symbols(block) / by, class_bytes(block, _BANG) / by,
        class_bytes(block, _HIGH) / by, words / np.maximum(n_lines, 1), per_document(again_line, cut) / np.maximum(n_lines, 1), 1 - per_document(again_word, block.first) / n_words, repeated_window_words(block, hashes) / n_words, per_document(short, cut) / np.maximum(n_lines, 1),
    ]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns, then the statistics of the whole text; and the names these got."""
    names = []
    for s in STATISTICS:
        names.append(fresh(s, [*docs.columns, *names]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    place = docs.columns.index(text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(b) for b in blocks(batch.column(place), SPACE_WORDS, fold=False)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:, k]) for k in range(len(names)))], names=schema.names)

    return docs.mapInArrow(measure, schema), names


@dataclass
class RuleModel:
    """Rules are conjunctions {statistic: (above, at most)}; score = logistic(bias + sum of the weights of the rules that hold)."""

    rules: list[dict[int, tuple[float, float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, names: list[str]) -> Column:
        """The score as a Spark column over the statistics."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = None
            for k, (low, high) in sorted(rule.items()):
                for part in ([F.col(names[k]) > low] if np.isfinite(low) else []) + ([F.col(names[k]) <= high] if np.isfinite(high) else []):
                    held = part if held is None else held & part
            z = z + F.when(held, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_matrix(rules: list[dict[int, tuple[float, float]]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, (low, high) in rule.items():
            out[:, j] *= (x[:, k] > low) & (x[:, k] <= high)
    return out


def _paths(x: np.ndarray, gradient: np.ndarray, features: np.ndarray, depth: int, least: int) -> tuple[list[dict], list[float]]:
    """Paths to all nodes but the root of a regression tree on the gradient, with the nodes' means; leaves' rules partition the rows."""
    rules, leaves = [], []

    def grow(rows: np.ndarray, path: dict, level: int) -> None:
        best = (1e-9, None, None)
        g = gradient[rows]
        if level < depth and len(rows) >= 2 * least:
            base = g.sum() ** 2 / len(g)
            for k in features:
                order = np.argsort(x[rows, k], kind="stable")
                v, total = x[rows[order], k], np.cumsum(g[order])
                at = np.flatnonzero(v[1:] > v[:-1]) + 1
                at = at[(at >= least) & (at <= len(rows) - least)]
                if not len(at):
                    continue
                left = total[at - 1]
                gain = left**2 / at + (total[-1] - left) ** 2 / (len(rows) - at) - base
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], k, float((v[at[j] - 1] + v[at[j]]) / 2))
        if best[1] is None:
            if path:
                leaves.append((path, rows))
            return
        k, cut = int(best[1]), best[2]
        low, high = path.get(k, (-np.inf, np.inf))
        for rule, part in (({**path, k: (low, min(high, cut))}, rows[x[rows, k] <= cut]), ({**path, k: (max(low, cut), high)}, rows[x[rows, k] > cut])):
            rules.append(rule)
            grow(part, rule, level + 1)

    grow(np.arange(len(x)), {}, 0)
    return rules, leaves


def _lasso(x: np.ndarray, y: np.ndarray, strength: float, start: tuple[np.ndarray, float], steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient of the mean logistic loss with an L1 penalty; the bias is free."""
    w, b = start
    rate = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 / len(x) + 1))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        new = v - rate * (x.T @ (p - y)) / len(x)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        bias = c - rate * (p - y).mean()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), bias + (t - 1) / t_new * (bias - b)
        w, b, t = new, bias, t_new
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 5) -> RuleModel:
    """Grow boosted trees on random halves of the rows, take all node paths as rules, and keep those the lasso gives a weight."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    score, rules = np.zeros(len(y)), []
    for _ in range(trees):
        part = rng.permutation(len(y))[: max(2, len(y) // 2)]
        features = rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        gradient = y - 1 / (1 + np.exp(-score))
        found, leaves = _paths(x[part], gradient[part], features, depth, max(3, len(part) // 200))
        rules += found
        for path, rows in leaves:
            p = 1 / (1 + np.exp(-score[part[rows]]))
            step = gradient[part[rows]].sum() / (p * (1 - p)).sum().clip(1e-3)
            score += 0.3 * np.clip(step, -4, 4) * rule_matrix([path], x)[:, 0]
    matrix = rule_matrix(rules, x)
    _, keep = np.unique(matrix, axis=1, return_index=True)
    keep = np.sort([k for k in keep if 0 < matrix[:, k].sum() < len(y)])
    rules, matrix = [rules[k] for k in keep], matrix[:, keep]
    order = rng.permutation(len(y))
    fit, rest = order[: len(order) * 4 // 5], order[len(order) * 4 // 5 :]
    start, losses = (np.zeros(len(rules)), float(np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3)))), []
    path = np.geomspace(0.03, 0.0003, 8)
    for strength in path:
        start = _lasso(matrix[fit], y[fit], strength, start)
        z = matrix[rest] @ start[0] + start[1]
        losses.append(np.logaddexp(0, -z * (2 * y[rest] - 1)).mean())
    strength = next(s for s, loss in zip(path, losses, strict=True) if loss <= min(losses) * 1.02 + 1e-4)
    weights, bias = _lasso(matrix, y, strength, (np.zeros(len(rules)), 0.0), 600)
    chosen = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([rules[k] for k in chosen], [float(weights[k]) for k in chosen], float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, label_id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, label_<column> ...): at most 2 * max_rows rows of labelled documents (doc_id, text) that are not held out, drawn by a hash of the id.

    A document id counts once for each of its labels, with the text of the smallest hash, however often its row is repeated.
    """
    known = labels.where(F.col(label_id_col).isNotNull() & ~held_out(label_id_col) & F.coalesce(*[F.col(c) for c in columns]).isNotNull())
    named = [f"label_{c}" for c in columns]
    known = known.select(F.col(label_id_col).cast("long").alias("doc_id"), *[F.col(c).alias(n) for c, n in zip(columns, named, strict=True)]).distinct()
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(draw < share * float(1 << 40)).orderBy(draw, *named).limit(2 * max_rows)
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", *named).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Learn from about max_rows labelled rows (twice that at most), whole texts; held-out ids and null labels are not used. Only statistics reach the driver."""
    sample = labelled_sample(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels, [label_col], max_rows)
    measured, names = with_statistics(sample)
    rows = measured.select(f"label_{label_col}", *names, "doc_id").orderBy("doc_id", f"label_{label_col}", *names).collect()
    x = np.array([[r[n] for n in names] for r in rows]).reshape(-1, len(names))
    return fit_rules(x, np.array([float(r[f"label_{label_col}"]) for r in rows]))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """All columns, then quality_score (underscores where docs has that name): the compiled rules on whole texts.

    Defined results: null and empty texts have zero statistics and are scored like any others; every row is scored, equal texts equally; an empty
    table gives no rows; without usable labels every score is 0.5, and with one class only its smoothed share.
    """
    measured, names = with_statistics(docs, text_col)
    return measured.select(*[F.col(f"`{c}`") for c in docs.columns], model.column(names).alias(fresh("quality_score", docs.columns)))
