"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import (
    divergence,
    hnsw,
    katz,
    langid,
    licenses,
    merkle,
    mixing,
    pieces,
    quality,
    sharding,
    simhash,
    suffix,
    token_cache,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, spans = mixing.mix(documents(spark, sf_dir))
    return mixing.words_taken(listed, spans).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLES["op1_mix_sources"] = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS ix
  FROM d GROUP BY src),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(ix % 3 + 1)::INT] AS wt, (2 * source_size)::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS total
  FROM s),
f AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, ix
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wt) OVER (ORDER BY cap / wt, ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            AS lv
  FROM w),
t AS (
  SELECT src, source_size,
         least(cap, wt * (SELECT arg_min(lv, (cap / wt, ix)) FROM f WHERE lv <= cap / wt))::DOUBLE
         AS target
  FROM f),
p AS (
  SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY d.src ORDER BY k, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS lo
  FROM d JOIN t ON t.src = d.src)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(lo + size, goal) - lo)
        + greatest(0, least(lo + source_size + size, goal) - lo - source_size))::BIGINT AS taken
FROM p
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def piece_digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of ids and text, of decoded documents; ``more`` columns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        *more,
    )


@query
def op3_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode_documents(documents(spark, sf_dir), model)
    return piece_digests(pieces.decode_documents(encoded, model))


@query
def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = katz.score_documents(documents(spark, sf_dir), least_pair=1)
    return scores


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("body").cast("bigint")

    def covered(begins: str, ends: str):
        sizes = F.zip_with(begins, ends, lambda b, e: e - b)
        return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return suffix.repeats_and_passages(documents(spark, sf_dir)).select(
        F.col("_row.doc_id").alias("doc_id"),
        size.alias("n_bytes"),
        covered("begins", "ends").alias("n_removed"),
        F.size("begins").cast("bigint").alias("n_spans"),
        F.sha2(suffix.kept_bytes(), 256).alias("kept_sha256"),
        covered("passage_begins", "passage_ends").alias("n_passage_bytes"),
        F.size("passage_begins").cast("bigint").alias("n_passage_spans"),
    )


@query
def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learned(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


@query
def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op10_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(documents(spark, sf_dir)))


_FIELDS = " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    for c in ("doc_id", "source", "lang", "{chars}", "text")
)

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree,
         sha256({_FIELDS.format(chars="n_chars")}) AS leaf,
         sha256({_FIELDS.format(chars="(n_chars + 1)")}) AS altered,
         coalesce(xor(list_reduce([4294967295::BIGINT]
             || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda c, o: xor(c >> 8, crc[(xor(c, o) & 255) + 1])), 4294967295) % 7 = 0, false) AS bad
  FROM documents, crc_table),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix,
         row_number() OVER () AS id
  FROM d),
lower(tree, lvl, ix, h, n) AS (
  SELECT tree, 0, ix, leaf, count(*) OVER (PARTITION BY tree) FROM l
  UNION ALL
  SELECT tree, lvl + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (n + 1) // 2
  FROM lower WHERE n > 1 GROUP BY tree, lvl, ix // 2, n),
tops AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS ix FROM lower WHERE n = 1),
upper(lvl, ix, h, n) AS (
  SELECT 0, ix, subroot, count(*) OVER () FROM tops
  UNION ALL
  SELECT lvl + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (n + 1) // 2
  FROM upper WHERE n > 1 GROUP BY lvl, ix // 2, n),
steps AS (
  SELECT l.id, 0 AS part, o.lvl, o.ix & 1 AS slot, s.h
  FROM l JOIN lower o ON o.tree = l.tree AND o.ix = l.ix >> o.lvl AND o.n > 1
    LEFT JOIN lower s ON s.tree = o.tree AND s.lvl = o.lvl AND s.ix = xor(o.ix, 1)
  UNION ALL
  SELECT l.id, 1, o.lvl, o.ix & 1, s.h
  FROM l JOIN tops t ON t.tree = l.tree JOIN upper o ON o.ix = t.ix >> o.lvl AND o.n > 1
    LEFT JOIN upper s ON s.lvl = o.lvl AND s.ix = xor(o.ix, 1)),
path AS (
  SELECT id, string_agg(h, '' ORDER BY part, lvl) AS siblings,
         list(CASE WHEN h IS NULL THEN '-' WHEN slot = 1 THEN 'L' || h ELSE 'R' || h END
              ORDER BY part, lvl) AS steps
  FROM steps GROUP BY id),
f AS (
  SELECT l.doc_id, l.leaf, t.subroot, (SELECT h FROM upper WHERE n = 1) AS root,
         sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce([CASE WHEN bad THEN altered ELSE leaf END] || coalesce(steps, []),
           lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a WHEN s[1] = 'R' THEN a || s[2:]
                            ELSE a END)) AS folded_root
  FROM l JOIN tops t ON t.tree = l.tree LEFT JOIN path ON path.id = l.id)
SELECT *, folded_root = root AS verified FROM f
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, words = divergence.audit(documents(spark, sf_dir))
    named = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank"
    )
    return named(pairs, "pair").unionByName(named(words, "term"))


_SHARE = "(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * kept))"

ORACLES["op12_source_divergence"] = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         list_transform(
           regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
  FROM documents),
o AS (SELECT lang, source, id, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term)
  GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS kept, sum(total) AS whole FROM k GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s
    LEFT JOIN c ON c.lang = s.lang AND c.source = s.source
  GROUP BY s.lang, s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         {_SHARE.format(count="coalesce(c.n, 0)", total="g.total")} AS p,
         {_SHARE.format(count="k.total", total="whole")} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that the figures are those of texts never met before."""
    cache = f"{shared_folder(spark)}/gridloom-token-counts-{uuid.uuid4().hex}"
    tokenizer = token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return token_cache.count_tokens(documents(spark, sf_dir), tokenizer, cache)
