"""The queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curves, lyndon, mixing, packing, phrases, quality, sharding, simhash, suffixes, surrogates, token_counts, toxicity, wrappers
from .common import WORD, table


def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.isolate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "anomaly")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.pseudonymize(table(spark, sf_dir, "documents"))
    return replaced.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "n_replaced")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), fields=("source", "lang", "text"))


def op9_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_powers(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; where crc32(doc_id) ends in 0, of its words made periodic from word a on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    counted = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    root = placed.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    periodic = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    made = root.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))
    found = lyndon.word_runs(made)
    first = F.expr(  # of greatest exponent: the earliest in the order of runs
        "aggregate(runs, runs[0], (best, run) -> if(run.length * best.period > best.length * run.period, run, best))"
    )
    listed = F.expr("array_join(transform(runs, run -> concat(run.start, ',', run.length, ',', run.period, '\n')), '')")
    chosen = found.withColumn("best", F.when(F.size("runs") > 0, first))
    return chosen.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that op3 judges by, and its base rules, which SQL can say."""
    stats = quality.rule_statistics(table(spark, sf_dir, "documents"))
    return stats.withColumn("base_failed", quality.base_failed())


QUERIES = {
    "op1_hilbert_neighbours": op1_hilbert_neighbours,
    "op2_subword_toxicity": op2_subword_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_surrogates": op4_surrogates,
    "op5_mix_sources": op5_mix_sources,
    "op6_simhash_vptree": op6_simhash_vptree,
    "op7_wrapper_induction": op7_wrapper_induction,
    "op8_token_attribution": op8_token_attribution,
    "op9_suffix_runs": op9_suffix_runs,
    "op10_pack_powers": op10_pack_powers,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_minimax_shards": op12_minimax_shards,
    "op13_pivot_phrases": op13_pivot_phrases,
    "rule_statistics": rule_statistics,
}

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, md5(text), '~'))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sizes
), ratios AS (
  SELECT *, (2 * source_size)::DOUBLE / weight AS ratio FROM ranked
), levels AS (
  SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
         / (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)))::DOUBLE AS level
  FROM ratios
  WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), reach AS (
  SELECT arg_min(level, ratio) FILTER (level < ratio) AS height FROM levels
), targets AS (
  SELECT source, source_size,
         CASE WHEN height IS NULL OR ratio <= height THEN (2 * source_size)::DOUBLE ELSE weight * height END AS target
  FROM levels, reach
), rates AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rates
"""

RULE_STATISTICS_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS gram FROM words, unnest(range(1, len(w) - 1)) AS t(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
       len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
"""

#: Every 50-byte string of every document; starts that a smaller id holds; the runs they cover and what lies between.
OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), strings AS (
  SELECT doc_id, p, md5(b[p:p + 49]) AS s FROM docs, unnest(range(1, n - 48)) AS t(p)
), held AS (
  SELECT doc_id, p FROM strings QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id
), edges AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS opens FROM held
), numbered AS (
  SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges
), spans AS (
  SELECT doc_id, span, min(p) AS begin_at, max(p) + 50 AS end_at FROM numbered GROUP BY ALL
), removed AS (
  SELECT doc_id, sum(end_at - begin_at)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), pieces AS (
  SELECT doc_id, end_at AS a, lead(begin_at) OVER (PARTITION BY doc_id ORDER BY begin_at) AS z FROM spans
  UNION ALL SELECT doc_id, 1, min(begin_at) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(b[a:coalesce(z, n + 1) - 1]), '' ORDER BY a) AS h
  FROM pieces JOIN docs USING (doc_id) WHERE coalesce(z, n + 1) > a GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM worded, unnest([1, 2, 3, 4, 5]) AS t(m), unnest(range(1, len(w) - m + 2)) AS u(i)
), counts AS (
  SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), known AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE a >= 100
), within AS (
  SELECT lang, array_to_string(w[1:words - 1], ' ') AS phrase, a FROM known WHERE words > 2
  UNION ALL SELECT lang, array_to_string(w[2:words], ' '), a FROM known WHERE words > 2
), maximal AS (
  SELECT * FROM known
  WHERE words > 1 AND NOT EXISTS (SELECT 1 FROM within WHERE within.lang = known.lang AND within.phrase = known.phrase AND within.a >= known.a)
), cuts AS (
  SELECT m.lang, m.phrase, m.a, k, p.a AS l, q.a AS r, n, ((1000::HUGEINT * m.a * n) // (p.a::HUGEINT * q.a))::BIGINT AS score
  FROM maximal m, unnest(range(1, m.words)) AS t(k)
  JOIN totals ON totals.lang = m.lang
  JOIN known p ON p.lang = m.lang AND p.phrase = array_to_string(m.w[1:k], ' ')
  JOIN known q ON q.lang = m.lang AND q.phrase = array_to_string(m.w[k + 1:m.words], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op5_mix_sources": OP5_SQL, "op9_suffix_runs": OP9_SQL, "op13_pivot_phrases": OP13_SQL, "rule_statistics": RULE_STATISTICS_SQL}
