"""Soft-membership mixing: predicted domain posteriors, and nonnegative document rates by least squares in the domain totals."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.blocks import ALNUM_WORDS, SPACE_WORDS, Block, blocks, windows
from offsetlake.llm.fitting import fit_in_task
from offsetlake.llm.rule_ensemble import labelled_sample, statistics
from offsetlake.llm.scratch import fresh, materialise

log = logging.getLogger(__name__)

#: The domains that the labelled table defines: toxic where toxic = 1, else low where quality = 0, else clean.
DOMAINS = ("clean", "low", "toxic")


@dataclass
class DomainModel:
    words: np.ndarray  # sorted hashes of the telling words
    tells: np.ndarray  # the domain that each tells
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (domains + statistics + 1, domains)

    def features(self, plain: Block, measured: np.ndarray) -> np.ndarray:
        """From a block and its statistics: for each domain the logarithm of 1 + how many different words that tell it occur, standardised statistics, 1."""
        held = np.zeros((plain.documents, len(DOMAINS)))
        hashes = plain.hashes()
        if len(self.words) and len(hashes):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            hit = self.words[at] == hashes
            found = np.unique(np.stack((plain.word_document()[hit], at[hit])), axis=1)
            np.add.at(held, (found[0], self.tells[found[1]]), 1)
        x = np.clip((measured - self.centre) / self.scale, -5, 5)
        return np.concatenate((np.log1p(held), x, np.ones((len(x), 1))), axis=1)

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, posteriors) of whole texts; tokens are words without blanks."""
        tokens, p = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
        for plain, spaced in zip(blocks(column, ALNUM_WORDS, True), blocks(column, SPACE_WORDS, False), strict=True):
            z = self.features(plain, statistics(spaced)) @ self.weights
            z = np.exp(z - z.max(1, keepdims=True))
            p.append(z / z.sum(1, keepdims=True))
            tokens.append(np.diff(spaced.first))
        return np.concatenate(tokens), np.concatenate(p)


def train_domains(texts: pa.Array | pa.ChunkedArray, target: np.ndarray, least: int = 6, evidence: float = 45.0, steps: int = 400) -> DomainModel:
    """Multinomial logistic regression on words that tell a domain (chi-square of presence, over texts that are no copies) and on text statistics."""
    if not len(texts):
        return DomainModel(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(14), np.ones(14), np.zeros((len(DOMAINS) + 15, len(DOMAINS))))
    column = texts.cast(pa.large_binary())
    held, owners, marks = [], [], []
    for b in blocks(column, ALNUM_WORDS, True):
        hashes = b.hashes()
        each = [np.unique(hashes[b.first[d] : b.first[d + 1]]) for d in range(b.documents)]
        held.append(np.concatenate(each))
        owners.append(np.repeat(np.arange(b.rows.start, b.rows.stop, dtype=np.int32), [len(e) for e in each]))
        at, grams = windows(hashes, b.first, 8)
        cut = np.searchsorted(at, b.first)
        marks += [int(grams[cut[d] : cut[d + 1]].min()) if cut[d + 1] > cut[d] else -1 - b.rows.start - d for d in range(b.documents)]
    first = np.zeros(len(texts), bool)
    first[np.unique(np.array(marks, object), return_index=True)[1]] = True  # near copies often share their smallest 8-word hash
    owner = np.concatenate(owners)
    kept = first[owner]
    owner = owner[kept]
    words, number = np.unique(np.concatenate(held)[kept], return_inverse=True)
    counts = np.zeros((len(words), len(DOMAINS)))
    np.add.at(counts, (number, target[owner]), 1)
    del held, owners, owner, kept, number
    share = counts.sum(1, keepdims=True) / first.sum()
    expected = share * np.bincount(target[first], minlength=len(DOMAINS))
    chi = np.where(counts > expected, (counts - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    best = np.flatnonzero((counts.sum(1) >= least) & (chi.max(1) >= evidence))
    x = np.concatenate([statistics(b) for b in blocks(column, SPACE_WORDS, False)])
    model = DomainModel(words[best], chi[best].argmax(1), x.mean(0), x.std(0) + 1e-6, np.zeros((len(DOMAINS) + x.shape[1] + 1, len(DOMAINS))))
    x = np.concatenate([model.features(b, x[b.rows]) for b in blocks(column, ALNUM_WORDS, True)])
    y = np.eye(len(DOMAINS))[target]
    rate = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + 1e-4)
    w, v, t = model.weights, model.weights, 1.0
    for _ in range(steps):  # accelerated gradient with a small ridge
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - rate * (x.T @ (p - y) / len(x) + 1e-5 * v)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
    model.weights = w
    return model


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_row_bytes: int = 32768, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DomainModel:
    """Learn from about max_rows labelled rows (twice that at most) with texts up to max_row_bytes, drawn by a hash of the id; held-out ids are not used. One task fits."""
    narrow = docs.where(F.octet_length(text_col) <= max_row_bytes).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = labelled_sample(narrow, labels, [quality_col, toxic_col], max_rows)
    domain = F.when(F.col(f"label_{toxic_col}") == 1, 2).when(F.col(f"label_{quality_col}") == 0, 1).otherwise(0)
    rows = sample.select("doc_id", "text", domain.alias("domain"))

    def fit(table: pa.Table) -> DomainModel:
        return train_domains(table["text"], table["domain"].to_numpy().astype(np.int64))

    return fit_in_task(rows, ["doc_id", "text", "domain"], fit) or train_domains(pa.array([], pa.string()), np.zeros(0, np.int64))


def domain_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """All columns, then n_tokens and posteriors (array in the order of DOMAINS); and the names these two got."""
    names = [fresh("n_tokens", docs.columns), fresh("posteriors", docs.columns)]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = shared.value.posteriors(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(score, schema), *names


@dataclass
class Rates:
    """rate = max(0, 1 + posteriors . slopes); totals are the domains' expected tokens at these rates, targets what they should be."""

    slopes: list[float]
    totals: list[float]
    targets: list[float]

    def column(self, posteriors: str):
        p = F.col(posteriors)
        return F.greatest(F.lit(0.0), sum((p[k] * float(s) for k, s in enumerate(self.slopes)), F.lit(1.0)))

    def gap(self) -> float:
        """The sum over domains of |total - target|, as a part of all targets."""
        return float(np.abs(np.subtract(self.totals, self.targets)).sum() / max(sum(self.targets), 1e-300))


def fit_rates(scored: DataFrame, weights: dict[str, float], tokens_col: str, posteriors_col: str, budget: float | None = None, tolerance: float = 5e-3, least: float = 1e-6) -> Rates:
    """Nonnegative rates, one a document, whose expected domain token totals match weights * budget in least squares.

    budget is a number of tokens; None asks for the expected tokens of the domains with a positive weight, in the mixture's proportion that needs no
    domain above its own total. Minimises the sum over domains of (total - target)^2 / expected tokens, plus eps times the token-weighted
    sum of (rate - 1)^2, by projected gradient steps in their lazy form: the unprojected rates 1 + posteriors . slopes move against the gradient,
    and the rates are what is left of them at 0 or above. The gradient in the slopes is scaled by the inverse of the live documents'
    Gram matrix (those with a positive rate), with a search along the step; on the dual this is a Newton step. Steps without that scaling reach the same point in far
    more passes. eps falls by tens until the totals are within `tolerance` of the targets, or to `least`: an unscaled projected gradient step
    in the metric of token counts then changes no rate by more than eps * |rate - 1|, so the least-squares sum is stationary. Targets that no
    rates reach are logged; totals and targets are in the result. Each pass sums up one row of domain totals over the distributed table; only
    those reach the driver.
    """
    k = len(DOMAINS)
    n, p = F.col(tokens_col).cast("double"), F.col(posteriors_col)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    narrow = scored.select(n.alias("n"), p.alias("p"))

    def sums(slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Domain totals, their derivative by the slopes, and the token-weighted sum of rate^2."""
        r = Rates(slopes.tolist(), [], []).column("p")
        rows = narrow.select("n", "p", r.alias("r")).withColumn("live", F.when(F.col("r") > 0, F.col("n")).otherwise(0.0))
        parts = [F.sum(F.col("n") * F.col("r") * F.col("p")[j]) for j in range(k)] + [F.sum(F.col("live") * F.col("p")[i] * F.col("p")[j]) for i, j in upper] + [F.sum(F.col("n") * F.col("r") * F.col("r"))]
        got = np.array([float(v or 0.0) for v in rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(parts)]).first()])
        slope = np.zeros((k, k))
        for (i, j), v in zip(upper, got[k:-1], strict=True):
            slope[i, j] = slope[j, i] = v
        return got[:k], slope, got[-1]

    slopes = np.zeros(k)
    have, slope, square = sums(slopes)
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in DOMAINS])
    if share.sum() <= 0 or have.sum() <= 0:
        return Rates(slopes.tolist(), have.tolist(), have.tolist())
    share /= share.sum()
    if budget is None:
        budget = min(have[j] / share[j] for j in range(k) if share[j] > 0)
    target = share * budget
    now, floor = have, np.maximum(have, 1e-9 * have.sum())
    root, enough, eps = np.sqrt(floor), tolerance * target.sum(), 1.0
    while np.abs(now - target).sum() > enough and eps > least:
        eps = max(least, eps / 10)

        def dual(at: np.ndarray, square: float, eps: float = eps) -> float:
            return float(at @ target - square / 2 - eps / 2 * (floor * at) @ at)

        while np.abs(up := target - now - eps * floor * slopes).sum() > 0.1 * enough:
            step = np.linalg.solve(slope / np.outer(root, root) + eps * np.eye(k), up / root) / root
            value, length = dual(slopes, square), 1.0
            while length > 1e-9:
                tried = sums(slopes + length * step)
                if dual(slopes + length * step, tried[2]) >= value + 1e-4 * length * float(up @ step) - 1e-12 * abs(value):
                    break
                length /= 2
            else:
                raise ArithmeticError(f"no ascent in the dual at eps {eps}: totals {now.tolist()}, targets {target.tolist()}")
            slopes = slopes + length * step
            now, slope, square = tried
    rates = Rates(slopes.tolist(), now.tolist(), target.tolist())
    if rates.gap() > tolerance:
        log.warning("no rates reach the targets: domain totals %s, targets %s, gap %.4f", rates.totals, rates.targets, rates.gap())
    return rates


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, near: float = 0.1, id_col: str = "doc_id", text_col: str = "text", model: DomainModel | None = None, report: Callable[[Rates], None] | None = None) -> DataFrame:
    """All columns, then n_tokens, posteriors, rate and copies (underscores where docs has such names; always the last four).

    copies is the rate rounded: a rate within `near` of a whole number takes it, others go up with the chance of their fraction, by a
    hash of the id and text. Documents with 0 copies are not in the mixture. `report` gets the fitted rates with the achieved totals
    and the targets.

    Defined results: null and blank texts have no tokens and get posteriors like others, so their rate follows their domains'; rows with equal texts
    get equal rates; an empty table gives no rows; a domain without labelled rows gets small posteriors, and without labels all are equal.
    """
    model = model or fit_domains(docs, labels, id_col=id_col, text_col=text_col)
    scored, tokens, posteriors = domain_posteriors(docs, model, text_col)
    scored = materialise(scored, "scored")  # so that no text is scored twice; the passes read its two narrow columns
    key = fresh("draw", scored.columns)
    rates = fit_rates(scored, weights, tokens, posteriors, budget)
    if report:
        report(rates)
    rate, copies = fresh("rate", docs.columns), fresh("copies", docs.columns)
    draw = F.pmod(F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.round(F.col(rate))
    rounded = F.when(F.abs(F.col(rate) - whole) <= near, whole).otherwise(F.floor(F.col(rate) + F.col(key)))
    out = scored.withColumn(key, draw).withColumn(rate, rates.column(posteriors)).withColumn(copies, rounded.cast("int"))
    return out.drop(key)
