"""N-gram Jaccard join by vertical partitioning of the n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.blocks import SPACE_WORDS, blocks, release, span_hashes, windows
from offsetlake.llm.components import components
from offsetlake.llm.repeats import CountMin, chunked, documents
from offsetlake.llm.scratch import corpus_bytes, drop, materialise
from offsetlake.llm.skew import hot_join, hot_keys


def _sets(table: pa.Table, width: int) -> list[np.ndarray]:
    """For each row of a chunk, its sorted distinct n-grams."""
    out = []
    for b in blocks(table["text"], SPACE_WORDS, fold=True):
        hashes = b.hashes()
        at, grams = windows(hashes, b.first, width)
        cut = np.searchsorted(at, b.first)
        size = np.diff(b.first)
        for d in range(b.documents):
            out.append(np.unique(grams[cut[d] : cut[d + 1]]) if size[d] >= width else span_hashes(hashes, b.first[d : d + 1], b.first[d + 1 : d + 2])[: size[d]])
    return out


def ngram_sets(docs: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, grams): grams only where at least `percent` of them may occur in another text.

    A text with more n-grams of its own than that cannot link with any other, so it needs no join. The estimate is a
    count-min sketch's, which is never too low.
    """
    size = corpus_bytes(docs, text_col)
    chunks = chunked(docs, id_col, text_col)
    sketch = CountMin.for_text(size)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def keys(rows: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *_sets(rows, width)])

    def select(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = documents(table)
        sets = _sets(rows, width)
        sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate([np.zeros(0, np.uint64), *sets])
        shared = sketch.repeated(grams, told)
        held = np.add.reduceat(np.append(shared, False).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0) if len(sets) else sizes
        wanted = (sizes > 0) & (100 * held >= percent * sizes)
        out = pa.table({"doc_id": rows["doc_id"].combine_chunks(), "n_shingles": sizes, "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if w else None for s, w in zip(sets, wanted, strict=True)], "grams": pa.array([s.view(np.int64) if w else None for s, w in zip(sets, wanted, strict=True)], pa.list_(pa.int64()))}, schema=schema)
        del sets, grams, shared
        release()
        return out

    return chunks.groupBy("chunk").cogroup(sketch.exchange(chunks, keys).groupBy("chunk")).applyInArrow(select, "doc_id long, n_shingles long, set_hash binary, grams array<long>")


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The links (a, b), as ids, of the candidates (a, ia, na, b, ib, nb): overlaps are counted apart in every fragment and summed."""
    left = segments.select(F.col("id").alias("a"), "fragment", F.col("segment").alias("sa"))
    right = segments.select(F.col("id").alias("b"), "fragment", F.col("segment").alias("sb"))
    hot = [hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), c) for c in ("a", "b")]
    both = hot_join(hot_join(pairs, left, ["a"], hot[0]), right, ["b", "fragment"], hot[1])
    keys = ["a", "ia", "na", "b", "ib", "nb"]
    total = both.select(*keys, F.size(F.array_intersect("sa", "sb")).alias("part")).groupBy(*keys).agg(F.sum("part").alias("common"))
    return total.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, fragments: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): components of links with Jaccard of n-gram sets of at least percent/100.

    Equal sets are one node, represented by the smallest id. Texts of which more than the allowed part of n-grams occurs nowhere else are
    left out first (see ngram_sets). Nodes that may link share one of their rarest n-grams (prefix filter), at places
    that leave room for the overlap (positional filter). The global n-gram order is cut into `fragments`; for every candidate
    pair the overlap is counted apart in each fragment and summed. Candidates are first only (node, hub) pairs, a hub being the node of
    a posting list with the most widely shared n-grams: linear in the postings, and it joins up groups of near copies. Then
    all pairs whose ends are still in different components follow. So no link between components is lost and
    the pairs inside a group are not enumerated.

    Defined results: empty, blank and null texts have no n-grams and their own component; fewer than `width` words are one
    n-gram; rows with equal ids are one node, each with its own n_shingles; a null id gets a null component; no rows for an empty table.
    Only the two named columns are read.
    """
    sets = materialise(ngram_sets(docs, percent, width, id_col, text_col), "sets")
    held = sets.where("grams IS NOT NULL AND doc_id IS NOT NULL")
    first = materialise(held.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "first")
    # Copies meet their smallest id in parts, so that a group of a third of all rows is not one task's.
    members = hot_join(held.select("doc_id", "set_hash"), first.where("n > 1").select("set_hash", "id"), ["set_hash"], hot_keys(first, "set_hash"))
    members = materialise(members.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "members")
    nodes = held.join(first.select(F.col("id").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi").dropDuplicates(["doc_id", "set_hash"])
    # A node is a set: an id whose rows differ in text may stand for several sets, which that id then connects.
    nodes = nodes.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "set_hash").alias("node"), F.col("n_shingles").alias("n"), "grams")
    exploded = nodes.select("id", "node", "n", F.explode("grams").alias("gram"))
    often = materialise(exploded.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = hot_join(exploded, often, ["gram"], hot_keys(often.select("gram", F.col("df").alias("n")), "gram"))
    ordered = shared.groupBy("id", "node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("order"), (F.sum("df") / F.col("n")).alias("spread"))
    ordered = materialise(ordered.where(F.lit(100) * F.size("order") >= F.lit(percent) * F.col("n")).withColumn("own", F.col("n") - F.size("order")), "ordered")
    n, own = F.col("n"), F.col("own")
    prefix = n - F.expr(f"(n * {percent} + 99) div 100") + 1
    segments = materialise(
        ordered.select(F.col("node").alias("id"), F.explode("order").alias("o")).select("id", F.col("o.gram").alias("gram")).groupBy("id", F.pmod(F.shiftright("gram", 40), F.lit(fragments)).alias("fragment")).agg(F.collect_list("gram").alias("segment")), "segments"
    )
    postings = materialise(
        ordered.where(prefix > own).select("id", "node", "n", "spread", "own", F.posexplode(F.slice("order", F.lit(1), (prefix - own).cast("int"))).alias("at", "o")).select(F.col("o.gram").alias("gram"), "id", "node", "n", "spread", (n - own - F.col("at")).alias("room")), "postings"
    )
    drop(first, often, ordered)
    need = F.expr(f"((na + nb) * {percent} + {99 + percent}) div {100 + percent}")
    a_end = [F.col("id").alias("ia"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("room").alias("ra")]
    b_end = [F.col("id").alias("ib"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("room").alias("rb")]
    keys = ["a", "ia", "na", "b", "ib", "nb"]
    hubs = materialise(postings.groupBy("gram").agg(F.max(F.struct("spread", *b_end)).alias("hub"), F.count("*").alias("k")).where("k > 1").select("gram", "hub.*", "k"), "hubs")
    star = hot_join(postings.select("gram", *a_end), hubs.drop("spread", "k"), ["gram"], hot_keys(hubs.select("gram", F.col("k").alias("n")), "gram"))
    star = materialise(star.where((F.col("a") != F.col("b")) & (F.least("ra", "rb") >= need)).select(*keys).distinct(), "pairs")
    links = materialise(_overlaps(star, segments, percent).unionByName(members), "star")
    drop(hubs, star, members)
    labels = components(links)
    found = labels.select(F.col("node").alias("id"), "label")
    labelled = postings.join(found, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per_label = labelled.groupBy("gram", "label").agg(F.count("*").alias("k"))
    most = materialise(per_label.groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"), F.sum("k").alias("n")).where("labels > 1"), "most")
    # A link's sizes differ by the factor 100 / percent at most, so its ends are in the same bucket of sizes or in neighbours.
    bucket = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9) if percent < 100 else n
    mixed = materialise(hot_join(labelled, most.select("gram", "main"), ["gram"], hot_keys(most, "gram")).withColumn("bucket", bucket.cast("long")), "mixed")
    # Every pair across components has an end outside the list's largest component.
    outside = mixed.where("label <> main").select("gram", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("label").alias("la"), *a_end)
    every = mixed.select("gram", "bucket", F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("inside"), *b_end)
    sizes = every.groupBy("gram", "bucket").agg(F.count("*").alias("n"))
    rest = hot_join(every, outside, ["gram", "bucket"], hot_keys(sizes, "gram", "bucket")).where((F.col("la") != F.col("lb")) & (F.col("inside") | (F.col("a") < F.col("b"))) & (F.least("ra", "rb") >= need))
    turned = F.col("a") < F.col("b")
    rest = rest.select(*[F.when(turned, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(keys, [*keys[3:], *keys[:3]], strict=True)]).distinct()
    rest = materialise(rest, "rest")
    late = materialise(_overlaps(rest, segments, percent), "late")
    if not late.isEmpty():
        before, labels = labels, components(links.unionByName(late))
        drop(before)
    drop(links, late, rest, mixed, most, postings, segments)
    # Rows without id have no label to look for; they would all be one key of the join.
    known = sets.where("doc_id IS NOT NULL").select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    unknown = sets.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")).unionByName(unknown)
