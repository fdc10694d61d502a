"""The registered queries of the ten operators: production parameters, whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.llm.arc_to_warc import arc_to_warc, pages_to_arc, read_archives
from offsetlake.llm.fm_decontam import decontaminate
from offsetlake.llm.langid import fit_languages, held_out, identify
from offsetlake.llm.line_quality import line_quality
from offsetlake.llm.mixing import DOMAINS, mix
from offsetlake.llm.ngram_join import jaccard_components
from offsetlake.llm.rule_ensemble import fit_quality, score_quality
from offsetlake.llm.scratch import materialise
from offsetlake.llm.sharding import interleave
from offsetlake.llm.substring_dedup import remove_repeated_substrings
from offsetlake.llm.token_counts import count_tokens, load_pieces
from offsetlake.session import ship

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_substrings(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = materialise(pages_to_arc(_read(spark, sf_dir, "pages")), "arc")
    records = read_archives(materialise(arc_to_warc(arc), "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _read(spark, sf_dir, "benchmark"), with_text=False)
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = interleave(narrow, 24, text_col="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    mixed = mix(docs, labels, {"clean": 0.97, "low": 0.03}, near=0.0)  # fractions of rates go up by chance, so that copies keep the fitted totals
    return mixed.select("doc_id", "n_tokens", *[F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), load_pieces(PIECES)).select("doc_id", "n_pretokens", "n_tokens")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = line_quality(_read(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ship(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_rule_ensemble_quality, op3_substring_dedup, op4_arc_to_warc, op5_fm_decontamination, op6_stratified_interleave, op7_soft_mixing, op8_trie_token_counts, op9_language_id, op10_line_quality, pipeline)}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END sh
      FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
shared AS (SELECT sh FROM g GROUP BY sh HAVING count(*) > 1),
gs AS (SELECT g.* FROM g JOIN shared USING (sh)),
big AS (SELECT gs.doc_id FROM gs JOIN n USING (doc_id) GROUP BY gs.doc_id, n.n HAVING 100 * count(*) >= 90 * n.n),
gb AS (SELECT gs.* FROM gs JOIN big USING (doc_id)),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) o FROM gb a JOIN gb b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * o >= 90 * (na.n + nb.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(other) component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') s FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
f AS (SELECT s, min(doc_id) m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hit, unnest(range(0, 13)) t(k)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
k AS (SELECT word.doc_id, count(gone.pos) n_removed, string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL) kept
      FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op4_arc_to_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT n, sha256(coalesce(html, '')) d FROM pages),
f AS (SELECT d, min(page_id) m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND n >= 100""",
    "op5_fm_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
ph AS (SELECT DISTINCT item_id, least(len(ws), 10) m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') s FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) t(i) WHERE len(ws) > 0),
win AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') s FROM w, (SELECT DISTINCT m FROM ph) sizes, unnest(range(1, len(ws) - m + 2)) t(i) WHERE len(ws) >= m),
hit AS (SELECT doc_id, i, win.m, item_id FROM win JOIN ph ON ph.m = win.m AND ph.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT i + k) n FROM hit, unnest(range(0, m)) t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n, string_agg(v, ',' ORDER BY v) s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR v FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_line_quality": r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') s FROM w, unnest(range(1, len(ws) - 1)) t(i) WHERE len(ws) >= 3),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) n FROM often, unnest(range(0, 3)) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) l FROM w),
words AS (SELECT doc_id, source, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') lw FROM lines),
sm AS (SELECT doc_id, source, l, array_to_string(lw, ' ') norm, len(lw) n FROM words WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) n FROM sm GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT doc_id) n FROM w GROUP BY source),
bad AS (SELECT sm.source, norm FROM sm JOIN host ON host.source IS NOT DISTINCT FROM sm.source GROUP BY sm.source, norm, host.n HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.05 * host.n),
gone AS (SELECT doc_id, sum(n) n FROM sm JOIN bad ON bad.source IS NOT DISTINCT FROM sm.source AND bad.norm = sm.norm GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
      coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words, coalesce(gone.n, 0) gone
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= 0.5 * n_words AND n_words - gone >= 50 AS kept FROM f""",
}
