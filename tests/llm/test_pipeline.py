import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from offsetlake.llm import mixing


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before or name == "mixing"
        before = now
    out = corpus_pipeline.sharding(spark, docs, folder).collect()
    assert len(out) == before and {r.shard for r in out} <= set(range(corpus_pipeline.SHARDS))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_brute_force(rows, width=5, percent=80):
    """The ids that stay: the smallest of each component of links."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and len(a & b) * 100 >= percent * len(a | b) and a:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i in parent}


def test_ngram_join_stage_uses_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(100)]
        edited = list(text)
        edited[30] = edited[70] = "edited"
        rows += [(10 * k, text), (10 * k + 1, text + [f"x{rng.randrange(5000)}" for _ in range(6 + 2 * k)]), (10 * k + 2, edited)]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = [r.doc_id for r in corpus_pipeline.ngram_join(spark, docs, "").collect()]
    assert set(got) == kept_by_brute_force(rows) and len(got) == len(set(got))
    assert len(got) < 36 - 12 and set(got) != kept_by_brute_force(rows, 3, 90)


def test_ngram_join_stage_keeps_one_row_of_each_id(spark):
    texts = [" ".join(f"w{(k * 131 + j * j) % 997}" for j in range(60)) for k in range(3)]
    rows = [(3, texts[0]), (3, texts[0]), (3, texts[1]), (5, texts[0]), (5, texts[0]), (8, texts[2]), (9, texts[2]), (None, texts[2]), (None, texts[2]), (11, None), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    first, again = [sorted(map(tuple, corpus_pipeline.ngram_join(spark, d, "").collect()), key=str) for d in (docs, docs.orderBy("text").repartition(5))]
    assert sorted(r[0] for r in first if r[0] is not None) == [3, 8, 11] and sum(r[0] is None for r in first) == 2
    assert first == again


def test_mixing_stage_follows_the_rates(spark, monkeypatch):
    """Copies of a real mixture: the domains' realised token totals are the fitted ones, up to chance."""
    mixed, fitted = [], []

    def spy(*args, **options):
        mixed.append(mixing.mix(*args, report=fitted.append, **options))
        return mixed[0]

    monkeypatch.setattr(corpus_pipeline, "mix", spy)
    folder = "/root/testdata/sf0.01"
    out = corpus_pipeline.mixing(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    tokens, posteriors, rate, copies = mixed[0].columns[-4:]
    n, p = F.col(tokens), F.col(posteriors)
    sums = mixed[0].agg(F.sum(copies), *[F.sum(n * F.col(copies) * p[k]) for k in range(3)], *[F.sum((n * p[k]) ** 2 * (F.col(rate) - F.floor(rate)) * (1 - F.col(rate) + F.floor(rate))) for k in range(3)], F.max(F.abs(F.col(copies) - F.col(rate)))).first()
    assert fitted[0].targets[0] > 0 and fitted[0].targets[1] > 0 and sums[7] < 1
    assert all(abs(sums[1 + k] - fitted[0].totals[k]) <= 4 * sums[4 + k] ** 0.5 for k in range(3))
    assert sums[0] == out.count()
