"""The queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import bpe, collocations, embedding_dedup, exact_dedup, filter_audit, mixing, ngram_join, packing, quality, records, sharding, substring_dedup, toxicity
from meshloom.plans.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MULTILINGUAL_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), window=35)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the counts of the shards are at most one apart."""
    placed = sharding.assign(_documents(spark, sf_dir), n_shards=8)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_documents(spark, sf_dir), n=5)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS plain FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS nth,
                  count(*) OVER (PARTITION BY plain) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the shard and the place in it of each copy that the tree deals out; ``taken`` counts their words."""
    rows = mixing.mix(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "shards", "place")


def _scored(rows: DataFrame, threshold: float) -> DataFrame:
    held_out = ~toxicity.in_training(F.col("doc_id"))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.score(_documents(spark, sf_dir), _labels(spark, sf_dir)), 0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return _scored(toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir))), 0.5)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    records.write(_documents(spark, sf_dir), path, TOKENIZER)
    return records.starts(records.write_index(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), MULTILINGUAL_RANKS)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir), longest=3, least=10, top=2000, percent=50)


OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
     s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
     f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
           FROM s, (VALUES (1), (2), (3)) v(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
     c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
     k AS (SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
     x AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, l.f AS l, r.f AS r, 1000000 * k.a * k.a // (l.f * r.f) AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
                  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ')),
     y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM x),
     b AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS within
           FROM (SELECT lang, a, ws, unnest([1, 2]) AS j FROM c WHERE m = 3) GROUP BY 1, 2),
     z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank
           FROM y LEFT JOIN b ON b.lang = y.lang AND b.phrase = y.phrase
           WHERE nth = 1 AND (within IS NULL OR 100 * within < 50 * a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM z JOIN n USING (lang) WHERE rank <= 2000"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), _labels(spark, sf_dir))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, row_number() OVER () AS nth FROM d),
     l AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
     q AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
     m AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
                         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
                  coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
           FROM w JOIN l USING (t) LEFT JOIN q USING (doc_id)),
     g AS (SELECT part, fails, list_sum(list_transform(fails, lambda x: CAST(x AS INT))) AS k, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, fails),
     a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM a, a b, a c, a d, a e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS bit,
                  list_transform(range(1, step), lambda j: ascii(filter_order[j]) - 64) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
     x AS (SELECT g.*, filter_order, step, fails[bit] AS own, len(list_filter(before, lambda j: fails[j])) > 0 AS gone FROM g, s)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN own AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN own THEN n * 120 // k ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), TOKENIZER, length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Query]:
    found = (
        op1_substring_dedup, op2_sharding, op3_ngram_join, op4_exact_dedup, op5_mixing,
        op6_quality, op7_toxicity, op8_token_records, op9_embedding_dedup, op10_byte_bpe,
        op11_collocations, op12_filter_audit, op13_packing,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL}
