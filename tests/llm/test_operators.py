"""Edge cases and brute-force comparisons of the operators, on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import arc_to_warc as A
from offsetlake.llm.components import components
from offsetlake.llm.fitting import fit_in_task
from offsetlake.llm.fm_decontam import FMIndex, decontaminate, suffix_array
from offsetlake.llm.langid import fit_languages, held_out, identify
from offsetlake.llm.line_quality import line_quality, without_frequent_lines
from offsetlake.llm.mixing import DOMAINS, fit_rates, mix
from offsetlake.llm.ngram_join import jaccard_components
from offsetlake.llm.repeats import CountMin
from offsetlake.llm.rule_ensemble import fit_quality, fit_rules, score_quality
from offsetlake.llm.sharding import interleave
from offsetlake.llm.substring_dedup import remove_repeated_substrings
from offsetlake.llm.token_counts import MARK, Trie, count_tokens

#: Extra columns clash with names that the operators use or add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, n_words int, shard string, rate string, n_tokens int, lang_pred string, host string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "c", 1, "s", "r", 2, "x", "h")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base, passage = words(rng, 120, 400), words(rng, 30, 400)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[10:110:7] = ["other"] * 15
    rows = [
        row(5, base), row(3, base), row(9, " ".join(near)), row(12, " ".join(far)), row(7, passage + " " + words(rng, 40, 400)), row(2, words(rng, 50, 400) + "\n" + passage), row(20, None), row(21, ""), row(22, " \n\t "), row(23, "One two"), row(24, "one TWO"),
        row(None, base), row(30, "é ü\nß é ü ß", None, None), row(31, "!!! 123 ###"), row(40, words(rng, 3000, 5000)), row(41, "a b c d e f g h i j k l m n " * 4), row(5, base),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def test_ngram_join(docs, empty):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == Counter((i, len(s), None if i is None else find(i)) for i, s in rows)
    assert got[(24, 1, 23)] == 1 and got[(9, 118, 3)] == 1
    assert jaccard_components(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def thue_morse(size, one="a", two="b"):
    return "".join((one, two)[bin(i).count("1") & 1] for i in range(size))


#: Words that a polynomial hash modulo a power of two cannot tell apart, and words that differ in a zero byte or at a lane's end.
CRAFTED = [thue_morse(n, *p) for n in (8, 16, 1024, 2048, 4096) for p in ("ab", "ba")] + ["a", "a\0", "a" * 8, "a" * 9, "a" * 16, "a" * 17]


def test_digests_tell_words_apart():
    import pyarrow as pa

    from offsetlake.llm.blocks import SPACE_WORDS, blocks, windows

    b = next(blocks(pa.array([" ".join(CRAFTED), None, " ".join(reversed(CRAFTED)), "", "A" * 20]), SPACE_WORDS, True))
    one, two = b.digests()
    own = one[: len(CRAFTED)].tolist()
    assert len(set(own)) == len(CRAFTED) and own[::-1] == one[len(CRAFTED) : 2 * len(CRAFTED)].tolist() and one[-1] == next(blocks(pa.array(["a" * 20]), SPACE_WORDS, True)).hashes()[0]
    assert b.hashes().tolist() == one.tolist() and len(set(two[: len(CRAFTED)].tolist())) == len(CRAFTED)
    rng, first = np.random.default_rng(1), np.array([0, 30, 30, 41, 1000])
    words_ = rng.integers(0, 3, 1000).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 10, 13):
        at, h = windows(words_, first, width)
        runs = [tuple(words_[k : k + width].tolist()) for k in at.tolist()]
        assert at.tolist() == [k for k in range(1000) if any(a <= k and k + width <= b for a, b in zip(first, first[1:]))]
        assert len(set(zip(runs, h.tolist()))) == len(set(runs)) == len(set(h.tolist()))


def test_crafted_texts_stay_apart(spark):
    """Texts of crafted words: no link, no removal, no hit, no repeated line."""
    texts = [" ".join([w] * 20) + "\n" + w for w in (thue_morse(1024), thue_morse(1024, "b", "a"))]
    table = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    assert {r.component_id for r in jaccard_components(table).collect()} == {0, 1}
    assert all(r.n_removed == 0 for r in remove_repeated_substrings(table).collect())
    assert [r.n_hit for r in decontaminate(table, spark.createDataFrame([(1, texts[1])], "item_id long, text string")).orderBy("doc_id").collect()] == [0, 21]
    both = spark.createDataFrame([row(0, thue_morse(1024) + "\n" + thue_morse(1024, "b", "a"))], SCHEMA)
    assert line_quality(both).first().n_dup_lines == 0


def test_count_min_never_low():
    import pyarrow as pa

    from offsetlake.llm.repeats import _PART, Tree, _held, _repeated, _twice

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    parts = [np.concatenate((keys[:3000], keys[:50])), keys[2500:], keys[:0]]
    sketch = CountMin(12, Tree(12, (4,), 3, _twice, _repeated, lambda merged, told: told, _held))
    by_path = {}
    for c, p in enumerate(parts):
        for r in sketch.parts(p, c):
            by_path.setdefault(r[1], []).append(r)
    told = []
    for rows in by_path.values():
        path, nodes, own = sketch.tree._own(sketch.tree.table(rows, _PART), 0)
        told.append(sketch.tree._tell(path, nodes, own, sketch.tree.top(sketch.tree.merge(own)), 0))
    told, count = pa.concat_tables(told), Counter(np.concatenate(parts).tolist())
    for c, p in enumerate(parts):
        said = sketch.repeated(p, told.filter(pa.array([n == c for n in told["node"].to_pylist()])))
        assert all(s for k, s in zip(p.tolist(), said) if count[k] > 1) and (not len(p) or not said.all())


def test_tree_of_many_levels(spark, docs, monkeypatch):
    """Tiny chunks and fans give a tree of several levels: the same results, and blobs that grow with the text."""
    from offsetlake.llm import repeats, substring_dedup
    from offsetlake.llm.ngram_join import ngram_sets

    want = [sorted(map(str, f(docs).collect())) for f in (remove_repeated_substrings, ngram_sets)]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 500)
    monkeypatch.setattr(repeats, "FAN_BITS", 2)
    assert len(CountMin.for_text(15000).tree.cuts) == 3
    assert [sorted(map(str, f(docs).collect())) for f in (remove_repeated_substrings, ngram_sets)] == want
    rng, sent = np.random.default_rng(5), []
    monkeypatch.setattr(repeats, "FAN_BITS", 3)
    for k in (1, 2, 4):
        many = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 10**9, 40).tolist()))) for i in range(160 * k)], "doc_id long, text string").repartition(2)
        chunks, sketch = repeats.chunked(many, "doc_id", "text"), CountMin.for_text(many.count() * 390)
        found = sketch.sent(chunks, lambda d: substring_dedup._chunk_windows(d, 13)[0]).groupBy("node").count().agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("chunks")).first()
        # however many ranges there are, a chunk sends 2**FAN_BITS blobs a sketch row at most
        assert found["chunks"] >= 80 * k and found["most"] <= sketch.depth << repeats.FAN_BITS
        sent.append(sum(sketch.tree.cuts))
    assert sent[2] == sent[0] + 2  # four times the ranges


def test_hot_keys_are_split(spark, monkeypatch):
    from offsetlake.llm import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, i) for i in range(30)], "k long, v long")
    few = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "k long, w string")
    hot = skew.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert {r["k"] for r in hot.rows} == {1, None} and hot.limit == 10
    for how in ("inner", "left"):
        got, want = skew.hot_join(many, few, ["k"], hot, how), many.join(few, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert skew.hot_keys(many.limit(0).groupBy("k").agg(F.count("*").alias("n")), "k").rows == []


def test_join_and_components_with_hot_keys(spark, monkeypatch):
    """Near copies and exact copies in large groups, every join split: the same components as by brute force."""
    from offsetlake.llm import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 3)
    rng, rows = random.Random(11), []
    for g, size in enumerate((40, 12, 3)):
        base = [f"w{rng.randrange(3000)}" for _ in range(90)]
        for k in range(size):
            own = list(base)
            own[rng.randrange(90)] = f"x{k % 7}"
            rows.append((100 * g + k, " ".join(own if k % 3 else base)))
    rows += [(None, rows[0][1])] * 20 + [rows[5]] * 8
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def test_substring_dedup(docs, empty):
    rows, width = [(r.doc_id, SPACE.findall(r.text or "")) for r in docs.collect()], 13
    first = {}
    for i, w in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    want = Counter()
    for i, w in rows:
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_substrings(docs).collect())
    assert got == want
    assert remove_repeated_substrings(empty).count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 6, 400)
    order = suffix_array(np.append(text + 1, 0))
    full = (text + 1).tolist() + [0]
    assert order.tolist() == sorted(range(401), key=lambda i: full[i:])
    index = FMIndex(text, 3)
    for size in (1, 2, 5):
        phrases = np.array([text[k : k + size] for k in range(0, 100, 9)] + [rng.integers(0, 6, size) for _ in range(20)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            found = sorted(index.locate(np.arange(a, b)).tolist())
            assert found == [k for k in range(401 - size) if text[k : k + size].tolist() == p.tolist()]


def test_decontamination(spark, docs, empty):
    passage = docs.where("doc_id = 2").first().text.split("\n")[1]
    bench = spark.createDataFrame([(1, passage.upper()), (2, "one two"), (3, None), (4, "..."), (None, "a b c"), (1, "ß é"), (7, passage)], "item_id long, text string")
    pattern, phrases = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}

    def tokens(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    for b in bench.collect():
        w = tokens(b.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and b.item_id is not None else 0):
            phrases.setdefault(tuple(w[k : k + n]), set()).add(b.item_id)
    out = decontaminate(docs, bench)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-5:] == ["n_words_", "n_hit", "hit_spans", "hit_items", "clean_text"]
    for r in out.collect():
        w, hit, items = tokens(r.text), set(), set()
        for p, ids in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= ids
        assert (r.n_words_, r.n_hit, r.hit_items) == (len(w), len(hit), sorted(items))
        assert tokens(r.clean_text) == [x for k, x in enumerate(w) if k not in hit] and (r.clean_text is None) == (r.text is None)
    named = bench.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"), "text")
    assert {r.doc_id: r.hit_items for r in decontaminate(docs, named).where("n_hit > 0").collect()} == {r.doc_id: [f"item-{i}" for i in r.hit_items] for r in out.where("n_hit > 0").collect()}
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_interleave(docs, empty):
    out = interleave(docs, 5, buckets=4)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    rows = out.collect()
    sizes = Counter(r["shard_"] for r in rows)
    assert len(rows) == 17 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r["shard_"] == s) == list(range(n)) for s, n in sizes.items())
    assert interleave(empty, 5).count() == 0


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_interleave_against_brute_force(spark, docs, buckets):
    """Shards and slots follow from the fractional ranks of the seeded order, whatever the number of buckets; also of a null source and small sources."""
    rng = random.Random(12)
    rows = [row(i, words(rng, 5), source=rng.choice(["big"] * 8 + ["mid"] * 3 + ["one", None])) for i in range(300)] + [row(900, "t", source="single")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = interleave(table, 24, buckets=buckets).withColumns({"key_": F.xxhash64(F.lit(17), "doc_id", "text"), "stratum_": F.xxhash64(F.lit(17), "source")}).collect()
    by_source = {}
    for r in sorted(out, key=lambda r: ((r.key_ % 2**64 >> 32) % buckets, r.key_)):
        by_source.setdefault(r.stratum_, []).append(r)
    order = sorted(((2 * k + 1) / len(g), s, r.key_, r.doc_id) for s, g in by_source.items() for k, r in enumerate(g))
    n, want = len(order), {}
    for at, (_, _, _, i) in enumerate(order):
        shard = at * 24 // n
        want[i] = (shard, at - -(-shard * n // 24))
    assert {r.doc_id: (r["shard_"], r.slot) for r in out} == want


def test_interleave_keeps_the_mixture(spark):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    per = {r.shard: r.n for r in interleave(many, 10).where("source = 'a'").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert all(24 <= n <= 26 for n in per.values()) and sum(per.values()) == 250


def test_archives(spark):
    rng = random.Random(4)
    same = words(rng, 60)
    rows = [(9, "http://a/ b", same), (4, None, same), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", "é" * 60 + "\r\n\r\nHTTP/1.1"), (None, "u", same), (4, None, same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc = A.pages_to_arc(pages)
    out = A.read_archives(A.arc_to_warc(arc)).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    def digest(t):
        return hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter([(9, len(same), digest(same), "revisit", 4), (4, len(same), digest(same), "response", None), (4, len(same), digest(same), "response", None), (5, 5, digest("small"), "response", None), (6, 5, digest("small"), "response", None), (7, 0, digest(None), "response", None), (8, 132, digest(rows[5][2]), "response", None), (None, len(same), digest(same), "response", None)])
    assert got == want
    assert A.read_archives(A.arc_to_warc(A.pages_to_arc(pages.limit(0)))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    content = A.arc_archive("x.arc", version, iter([("http://h/", "2001", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\n\nthere"), (None, "20010203040506", b"")]))
    first, second = A.read_arc(content)
    assert first["url"] == "http://h/" and A.split_http(first["body"])[1] == b"hello\n\nthere" and second["body"] == b"" and second["url"] == "-"
    assert A.warc_date("2001") == "2001-01-01T00:00:00Z" and A.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(A.read_arc(content[:-12]))


LEGACY = {
    1: b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n%shttp://h/a b.html 192.0.2.7 19970102030405 text/html; charset=utf-8 %d\n%s\nhttp://h/x.txt 192.0.2.8 1998 text/plain 5\nplain\n",
    2: b"filedesc://old.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 old.arc %d\n%shttp://h/a b.html 192.0.2.7 19970102030405 text/html; charset=utf-8 200 abc - 90 old.arc %d\n%s\nhttp://h/x.txt - 1998 text/plain 200 - - 300 old.arc 5\nplain\n",
}


@pytest.mark.parametrize("version,zipped", [(1, False), (2, False), (1, True)])
def test_legacy_archives(spark, version, zipped):
    """Blanks in URL and type, a record that is no HTTP response, gzip."""
    import gzip

    about = b"%d 0 somebody\n" % version + A.ARC_FIELDS[version] + b"\n"
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello</p>"
    content = LEGACY[version] % (len(about), about, len(body), body)
    page, plain = A.read_arc(gzip.compress(content) if zipped else content)
    assert (page["url"], page["type"], page["ip"], page["body"]) == ("http://h/a b.html", "text/html; charset=utf-8", "192.0.2.7", body)
    assert (plain["url"], plain["type"], plain["body"]) == ("http://h/x.txt", "text/plain", b"plain")
    warc = A.arc_to_warc(spark.createDataFrame([("old.arc", content)], "archive string, content binary")).first()
    kinds = [(f["warc-type"], f["content-type"], b) for f, b in A.read_warc(bytes(warc["content"]))][1:]
    assert kinds == [("response", "application/http; msgtype=response", body), ("resource", "text/plain", b"plain")]
    rows = A.read_archives(spark.createDataFrame([tuple(warc)], "archive string, content binary")).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in rows) == [("resource", 5), ("response", 12)]
    with pytest.raises(ValueError):
        list(A.read_arc(content.replace(b" 19970102030405 ", b" never ")))


def test_archives_of_empty_and_equal_pages(spark):
    """Empty pages fill archives too; equal rows in several partitions have archives, records and types of their own."""
    empty_pages = spark.range(5000).select(F.lit(None).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("html")).coalesce(1)
    sizes = [len(r.content) for r in A.pages_to_arc(empty_pages, archive_bytes=100_000).collect()]
    assert len(sizes) > 5 and max(sizes) < 120_000
    page = "x" * 200
    many = spark.createDataFrame([(1, "u", page)] * 4 + [(2, "u", page)] * 3, "page_id long, url string, html string").repartition(3)
    out = A.read_archives(A.arc_to_warc(A.pages_to_arc(many))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == {(1, "response", None): 4, (2, "revisit", 1): 3}
    assert len({r.record_id for r in out}) == 7 and {r.refers_to_id for r in out if r.page_id == 2} <= {r.record_id for r in out if r.page_id == 1}


def test_gzip_members_are_read_once(monkeypatch):
    """The bytes given to decompressors grow with the file, not with its square; members, padding and damage are as gzip has them."""
    import gzip
    import zlib

    fed, real = [0], zlib.decompressobj

    class Counted:
        def __init__(self, *args, **kwargs):
            self.inner = real(*args, **kwargs)

        def decompress(self, data, *args):
            fed[0] += len(data)
            return self.inner.decompress(data, *args)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    rng = random.Random(8)
    blocks = [rng.randbytes(2000) for _ in range(1000)]
    warc = b"".join(A.warc_record([("WARC-Type", "resource")], b) for b in blocks)
    body = b"HTTP/1.0 200 OK\r\n\r\n"
    arc = A.arc_archive("x.arc", 1, iter([("u", "2001", body + b) for b in blocks]))
    # a member for each 2,000 bytes, whatever records these cut, as .arc.gz files have many too
    zipped = b"".join(gzip.compress(arc[k : k + 2000]) for k in range(0, len(arc), 2000))
    monkeypatch.setattr(zlib, "decompressobj", Counted)
    assert [b for _, b in A.read_warc(warc)] == blocks
    assert fed[0] < 10 * len(warc)
    fed[0] = 0
    assert [r["body"] for r in A.read_arc(zipped)] == [body + b for b in blocks]
    assert fed[0] < 10 * len(zipped)
    monkeypatch.undo()
    assert list(A.read_warc(b"")) == [] and [b for _, b in A.read_warc(warc + bytes(700))] == blocks
    big = rng.randbytes(100_000)
    for cut in (gzip.compress(b""), gzip.compress(big), gzip.compress(big) + bytes(9000) + gzip.compress(b"x" * 10**6), b"".join(gzip.compress(b"y" * k) for k in range(300))):
        assert A.gunzip(cut) == gzip.decompress(cut)
    with pytest.raises(EOFError):
        list(A.read_warc(warc[:-3]))
    for damaged in (warc + b"more", warc[:-6] + b"\0\0" + warc[-4:], warc[:500] + b"!" + warc[501:]):
        with pytest.raises((zlib.error, OSError)):
            list(A.read_warc(damaged))


def test_fit_in_task(spark):
    rows = spark.createDataFrame([(k % 7, f"t{k}") for k in range(50)], "k int, t string").repartition(6)
    fitted = fit_in_task(rows, ["k", "t"], lambda table: (table["k"].to_pylist(), table["t"].to_pylist()))
    assert list(zip(*fitted, strict=True)) == sorted((k % 7, f"t{k}") for k in range(50))
    assert fit_in_task(rows.where("k > 9"), ["k"], len) is None


def test_language_id(spark, docs, empty):
    rng = random.Random(6)
    kinds = {"xx": ["kra", "ska", "tro", "ik"], "yy": ["lou", "mie", "eau", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=rng.randrange(1, 4))) for _ in range(30)), k) for i in range(200) for k in [rng.choice(sorted(kinds))]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(train)
    scored = identify(train.withColumn("held", held_out("doc_id")), model).where("held").collect()
    assert len(scored) > 20 and all(r.lang == r.lang_pred and 0 <= r.lang_score <= 1 for r in scored)
    out = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(out[i]["lang_pred_"] == "und" and out[i]["lang_rejected"] and out[i]["lang_score"] == 0 for i in (20, 21, 22, 31))
    assert identify(empty, model).count() == 0 and fit_languages(empty).languages == []
    assert {r["lang_pred_"] for r in identify(docs, fit_languages(empty)).collect()} == {"und"}


def test_line_rules(spark, docs, empty):
    rng = random.Random(7)
    rows = [row(i, f"Shared  LINE here\n{words(rng, 60, 900)}\nrepeat me\nrepeat me", source="h") for i in range(30)] + [row(100, "shared line here\n" + words(rng, 70, 900), source="other")]
    table = spark.createDataFrame(rows, SCHEMA).unionByName(docs)
    verdicts = line_quality(table)
    out = {r.doc_id: r for r in verdicts.collect()}
    assert out[3].n_dup_lines == 0 and out[0].n_dup_lines == 1 and out[0].n_line_words_removed == 7 and out[0].kept and out[100].n_line_words_removed == 0
    assert out[20].n_words == 0 and out[20].base_failed and not out[20].kept and out[41].n_repeat_words == 56 and out[41].base_failed
    assert out[31].n_symbols == 3 and out[30].word_chars == 6
    clean = {r.doc_id: r.text for r in without_frequent_lines(table, verdicts).collect()}
    assert "LINE" not in clean[0] and "repeat" not in clean[0] and clean[100].startswith("shared line here")
    assert line_quality(empty).count() == 0


def labelled(spark, n=400):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        kind = i % 4
        text = words(rng, 60 + i % 50, 3000)
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        if kind == 2:
            text += " vile " + words(rng, 5, 3000) + " nasty"
        rows.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rule_ensemble(spark, docs, empty):
    table, labels = labelled(spark)
    model = fit_quality(table, labels)
    rows = score_quality(table, model).join(labels, "doc_id").withColumn("held", held_out("doc_id")).where("held").collect()
    assert len(rows) > 50 and all((r.quality_score >= 0.7) == (r.quality == 1) for r in rows)
    assert all(0 <= r.quality_score <= 1 for r in score_quality(docs, model).collect())
    assert score_quality(empty, model).count() == 0
    assert abs(score_quality(docs, fit_rules(np.zeros((0, 14)), np.zeros(0))).first().quality_score - 0.5) < 1e-9
    assert all(r.quality_score > 0.9 for r in score_quality(docs, fit_quality(table, labels.withColumn("quality", F.lit(1)))).collect())


def test_held_out_accuracy(spark):
    """Quality and language of rows that nothing was learned from."""
    from offsetlake.llm.queries import op2_rule_ensemble_quality, op9_language_id

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    quality = op2_rule_ensemble_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    share = sum(r.quality for r in quality) / len(quality)
    assert len(quality) > 80 and sum(r.predicted == r.quality for r in quality) / len(quality) > max(0.95, share)
    known = op9_language_id(spark, folder).where("held_out AND lang_pred <> 'und'").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert len(known) > 200 and sum(r.lang == r.lang_pred for r in known) / len(known) > 0.98


def test_labelled_sample_is_bounded(spark):
    from offsetlake.llm.rule_ensemble import labelled_sample

    many = spark.range(4000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 80).cast("string")).alias("text"))
    labels = spark.range(200).select((F.col("id") % 40).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for most in (1, 10, 1000):
        sample = labelled_sample(many, labels, ["quality"], most).collect()
        assert len(sample) <= 2 * most and len({r.doc_id for r in sample}) == len(sample) and (most < 1000 or len(sample) > 20)


def test_mixing(spark, docs, empty):
    table, labels = labelled(spark)
    out = mix(table, labels, {"clean": 1.0}).join(labels, "doc_id").collect()
    assert all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in out)
    clean = [r for r in out if r.quality == 1 and r.toxic == 0]
    assert all(r.copies >= 1 for r in clean) and not any(r.copies for r in out if r.quality == 0 or r.toxic == 1)
    got = [sum(r.rate * r.n_tokens * r.posteriors[k] for r in out) for k in range(len(DOMAINS))]
    assert got[0] > 0.98 * sum(r.n_tokens for r in clean) and got[1] + got[2] < 0.02 * sum(got)
    assert mix(docs, labels, {"clean": 1.0}).count() == 17 and mix(empty, labels, {"clean": 1.0}).count() == 0


def test_token_counts(docs, empty):
    rng = random.Random(9)
    letters = "abc"
    pieces = {MARK: -1.0} | {"".join(rng.choices(letters, k=rng.randrange(1, 4))): -rng.random() * 9 for _ in range(20)} | {MARK + "a": -0.5, "a": -3.0, "b": -3.0}
    trie = Trie(pieces)

    def best(word):
        forward = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = [(forward[i - 1][0] + trie.unknown, forward[i - 1][1] - len(word[i - 1].encode()))]
            options += [(forward[j][0] + pieces[word[j:i]], forward[j][1] - 1) for j in range(i) if word[j:i] in pieces]
            forward.append(max(options))
        return -forward[-1][1]

    for _ in range(300):
        word = MARK + "".join(rng.choices(letters + "é", k=rng.randrange(1, 9)))
        assert trie.tokens(word) == best(word)
    out = count_tokens(docs, pieces).collect()
    for r in out:
        w = SPACE.findall(r.text or "")
        assert (r.n_pretokens, r["n_tokens_"]) == (len(w), sum(best(MARK + x) for x in w))
    assert count_tokens(empty, pieces).count() == 0


def test_trie_against_scalar_and_tokenizer(spark):
    """The level-wise trie gives the scalar forward pass's counts, long words too; Zipf's scores come near the tokenizer whose pieces they are."""
    import sentencepiece

    from offsetlake.llm.queries import PIECES
    from offsetlake.llm.token_counts import TRIE_CHARS, load_pieces

    pieces = load_pieces(PIECES)
    assert abs(sum(np.exp(list(pieces.values()))) - 1) < 1e-6
    trie, model = Trie(pieces), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    seen = sorted({w for t in texts for w in t.split()})
    odd = ["\U0001f600a" * 5, "é" * 200, "x" * (TRIE_CHARS - 1), "x" * TRIE_CHARS, "x" * 1000, "\u4f60\u597d", "a\0b", ""]
    got = trie.counts([MARK + w for w in seen + odd])
    assert got.tolist() == [trie.long(MARK + w) for w in seen + odd]
    assert got.tolist() == np.concatenate([trie.counts([MARK + w for w in (seen + odd)[k::3]]) for k in range(3)])[np.argsort(np.concatenate([np.arange(len(got))[k::3] for k in range(3)]))].tolist()
    own = np.array([len(model.encode(w)) for w in seen])
    assert abs(got[: len(seen)].sum() / own.sum() - 1) < 0.05 and (got[: len(seen)] == own).mean() > 0.75
    one = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string")
    assert count_tokens(one, pieces).first().n_tokens == trie.long(MARK + "x" * 3_000_000)


def test_rates_reach_their_targets(spark):
    """Softer and softer posteriors: totals within the tolerance where rates can reach the targets, else a stationary point; both are reported."""
    rng = np.random.default_rng(4)
    n, kind = rng.integers(50, 500, 3000), rng.choice(3, 3000, p=[0.75, 0.2, 0.05])
    for sharp, reachable in ((6.0, True), (3.0, True), (2.0, True), (0.0, False)):
        z = rng.normal(size=(3000, 3)) * (sharp > 0) + sharp * np.eye(3)[kind]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        scored = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(n, p, strict=True)], "n long, p array<double>").repartition(4).cache()
        rates = fit_rates(scored, {"clean": 0.97, "low": 0.03}, "n", "p")
        r = np.maximum(0, 1 + p @ rates.slopes)
        assert np.allclose((n * r) @ p, rates.totals, rtol=1e-6)
        step = np.maximum(0, r - p @ ((np.array(rates.totals) - rates.targets) / (n @ p)))
        assert rates.gap() <= 5e-3 if reachable else rates.gap() > 5e-3 and (np.abs(step - r) <= 1e-2 * np.abs(r - 1) + 1e-3).all()
        got = [x.r for x in scored.select(rates.column("p").alias("r")).orderBy("r").collect()]
        assert np.allclose(got, np.sort(r), atol=1e-6)
