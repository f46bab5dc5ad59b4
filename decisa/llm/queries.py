"""The thin queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisa.llm import alignment, genetic_packing, language_id, quality, repair
from decisa.llm.chat_format import chat_examples, read_examples
from decisa.llm.decontaminate import judge
from decisa.llm.fim import fim_examples, restored
from decisa.llm.jaccard_join import jaccard_components
from decisa.llm.mixing import mix_sources
from decisa.llm.multi_index import nearest
from decisa.llm.url_filter import filter_urls
from decisa.llm.warc import archive_pages

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document, by the n-gram Jaccard join."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component", "key")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back through the merged index of captures."""
    captures = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "rank")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others, by the inverted multi-index."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select(F.col("doc_id").alias("key"), "text"), quality.learnable(labels))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A tokenizer's file, op8's and the pipeline's byte-level BPE by default, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Re-Pair shards and read back from them."""
    return repair.encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the contract's rules on every page; without a fitting rule it is allow."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, RULES))} AS r(host, path, verdict)")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


TRICKY = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that is hard to escape, formatted and read back from the examples alone."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    talks = read_examples(chat_examples(rows.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    losses = F.array_join("losses", "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds a benchmark passage, which ones, and the best share of agreeing words."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.filter(_fold(3) != 1).select(F.col("doc_id").alias("key"), "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(learn))
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of two tokenizers' tokens in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return genetic_packing.packed(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle example, and the text rebuilt from it."""
    out = fim_examples(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha256 = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
    "op10_language_id": op10_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_mix_sources": op3_mix_sources,
    "op4_nearest": op4_nearest,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_token_output": op8_token_output,
    "op9_decontaminate": op9_decontaminate,
}

ORACLES = {
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
    "op1_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) m ON m.x = s.doc_id
""",
    "op3_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, cap / weight AS stops, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(p.cap) FROM o p WHERE p.k < o.k), 0))
    / ((SELECT sum(weight) FROM s) - coalesce((SELECT sum(p.weight) FROM o p WHERE p.k < o.k), 0)) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN w IS NULL OR stops < w THEN cap ELSE weight * w END AS target
  FROM l, (SELECT min_by(level, k) AS w FROM l WHERE level <= stops)
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_copies FROM t
), c AS (
  SELECT d.*, r.source_size, r.target, r.full_copies, r.target - r.full_copies * r.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), b AS (SELECT source, min(h) AS cut FROM c WHERE upto > rest GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (full_copies + CASE WHEN cut IS NULL THEN (rest > 0)::INT WHEN h < cut THEN 1 WHEN h = cut AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source
""",
    "op6_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(repr, RULES))}),
p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), m AS (
  SELECT p.*, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op7_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k)
), e AS (
  SELECT *, 14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<#:]', '', 'g')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c
), r AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(10), '%0A'), chr(13), '%0D') AS url FROM pages), h AS (
  SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p
), d AS (
  SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substring(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM h
), f AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url) AS k, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
), r AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to,
    CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^(?s:.*?)://([^/?#:]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) ELSE url END AS url_key FROM f
)
SELECT *, row_number() OVER (ORDER BY url_key, coalesce(page_id, -1), payload_digest, record_type) AS rank FROM r
""",
}
