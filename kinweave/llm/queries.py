"""The corpus operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lines, media, omh, packing, substrings, suffixes, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_suffixes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def op8_rabin_karp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op10_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(~langid.held_out("doc_id"))
    found = langid.identify(docs, learned)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each embedding of 64 numbers is read as a grey tile of 8 by 8, enlarged 4 times."""
    return media.image_copies(table(spark, sf_dir, "embeddings"), id_col="vec_id", media_col="embedding", width=8, enlarged=4)


QUERIES = {f.__name__: f for f in (op1_suffix_radix_dedup, op2_spaced_seed_decontamination, op3_deficit_packing, op10_deletion_line_dedup, op4_warc_normaliser, op5_cross_parsing_langid, op6_license_automaton, op7_order_minhash, op8_rabin_karp_dedup, op9_local_descriptors)}

ORACLES = {
    "op1_suffix_radix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, unnest(range(0, length(h) // 2 - 99)) AS t(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE k > 1)),
s AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM g GROUP BY doc_id, island),
k AS (SELECT s.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last,
             string_agg(substr(h, 2 * gap + 1, 2 * (b - gap)), '' ORDER BY b) AS kept
      FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS gap FROM s) s JOIN d USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op8_rabin_karp_dedup": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM w JOIN f USING (s), unnest(range(0, 13)) AS t(j) WHERE doc_id > m),
c AS (SELECT doc_id, i, ws[i] AS x FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM c ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op4_warc_normaliser": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(encode(h)) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first OR (d.page_id IS NULL AND f.first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first OR d.page_id IS NULL THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
}
