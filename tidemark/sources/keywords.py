"""A stored keyword index: postings in blocks with their best weights, and a top-k that skips what can't matter.

build() tokenizes texts once. A posting is a text's id and weight for a term,
BM25's without the term's rarity. Postings of a term lie in blocks by the first
bits of a hash of the id, as many bits as the term needs for about BLOCK
postings a block, so neither a rare nor a common term makes a huge row, and a
text's block for any term is known without a lookup. Each term keeps its count
and its best weight.

search() is exact. Rare terms of a question are summed first, and the best texts
by that are scored in full, which gives a score that the k-th best text at least
has. Terms whose best weights together stay below that score can't lift a text
that holds only them into the answer; the others' postings are read whole. Of
the texts found, those that could still reach the score by the best weights of
their blocks, which are read without the postings, are looked up in the common
terms' blocks. Questions and postings meet by joins on term and block; no step
holds all texts of a question or all questions of a text in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..session import kept

#: Postings of a block, about; postings summed for a first bound, about; and how far sums in another order may differ.
#: TRIED times k texts are scored in full for the bound.
BLOCK, SEED, SLACK = 64, 1000, 1e-8
TRIED = 4


def _block(id_: Column, bits: Column) -> Column:
    """The first bits of an id's hash."""
    return F.when(bits == 0, F.lit(0)).otherwise(F.expr("cast(shiftrightunsigned(hash, 64 - bits) as int)"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("id"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(docs: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content", k1: float = 1.2, b: float = 0.75) -> None:
    """Write the index of (id, text) rows to path: folders counts, stats, terms and postings.

    Null texts are empty and have no postings, but count as texts. Ids are
    unique. No rows: an index that finds nothing.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    each = texts.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term"))
    counts = _stored(each.groupBy("id", "length", "term").agg(F.count("term").alias("tf")), f"{path}/counts")
    lengths = counts.groupBy("id").agg(F.max("length").alias("length"))
    stats = _stored(lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), f"{path}/stats").first()
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(stats.mean or 1.0))
    weights = counts.where("term is not null").select("term", "id", (F.col("tf") * (k1 + 1) / norm).alias("w"))
    found = weights.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("best"))
    needed = F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / BLOCK))).cast("int")
    of_terms = _stored(found.withColumn("bits", needed).repartitionByRange("term").sortWithinPartitions("term"), f"{path}/terms")
    placed = _hashed(weights).join(of_terms.select("term", "bits"), "term").withColumn("block", _block(F.col("id"), F.col("bits")))
    blocks = placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("p"))
    rows = blocks.select("term", "block", F.size("p").alias("n"), F.array_max("p.w").alias("most"), F.col("p.id").alias("ids"), F.col("p.w").alias("ws"))
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 3, query_id: str = "query_id", query_text: str = "question"
) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, ord), (query_id, postings, read)): k best texts, ties to the smaller id, and the work.

    postings are those of the question's terms, read those in the blocks that
    were read for it. A question without known terms finds nothing. The same
    texts, scores and order as bm25() of search.py gives.
    """
    stats = spark.read.parquet(f"{path}/stats").first()
    blocks, of_terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term")).where("q is not null")
    idf = F.ln(1 + (F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(of_terms, "term").withColumn("idf", idf).withColumn("most", F.col("idf") * F.col("best"))
    rare = Window.partitionBy("q").orderBy("df", "term")  # of a question's terms
    known = kept(known.withColumn("seed", (F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0)) <= SEED) | (F.row_number().over(rare) == 1)))

    def summed(some: DataFrame) -> DataFrame:
        """(q, id, s): sums over whole postings of some terms."""
        met = blocks.join(some.select("q", "term", "idf"), "term").select("q", "idf", F.explode(F.arrays_zip("ids", "ws")).alias("p"))
        return met.groupBy("q", F.col("p.ids").alias("id")).agg(F.sum(F.col("idf") * F.col("p.ws")).alias("s"))

    def placed(texts: DataFrame, of: DataFrame) -> DataFrame:
        """(q, id, term, block, idf): where texts (q, id) lie in the postings of their questions' terms."""
        rows = _hashed(texts.select("q", "id")).join(of.select("q", "term", "idf", "bits"), "q")
        return rows.withColumn("block", _block(F.col("id"), F.col("bits"))).drop("hash", "bits")

    def looked_up(where: DataFrame) -> DataFrame:
        """(q, id, s): weights from single blocks."""
        weight = F.expr("idf * get(ws, cast(array_position(ids, id) as int) - 1)")
        return where.join(blocks, ["term", "block"]).select("q", "id", weight.alias("s")).where("s is not null")

    first = summed(known.where("seed")).withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id")))
    tried = kept(first.where(F.col("at") <= TRIED * k))
    tried_at = kept(placed(tried, known.where("not seed")))
    scores = tried.select("q", "id", "s").unionByName(looked_up(tried_at)).groupBy("q", "id").agg(F.sum("s").alias("s"))
    at = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    reached = scores.withColumn("at", at).where(F.col("at") == k).select("q", (F.col("s") - SLACK).alias("reached"))
    less = Window.partitionBy("q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    judged = known.join(reached, "q", "left").withColumn("below", F.sum("most").over(less))
    judged = kept(judged.withColumn("common", F.coalesce(F.col("below") < F.col("reached"), F.lit(False))))
    rest = judged.where("common").groupBy("q").agg(F.sum("most").alias("rest"), F.max("reached").alias("reached"))
    partial = summed(judged.where("not common")).join(rest, "q", "left")
    open_ = kept(partial.where("rest is null or s + rest >= reached"))
    asked_for = placed(open_, judged.where("common"))
    bound = asked_for.join(blocks.select("term", "block", "most"), ["term", "block"]).groupBy("q", "id").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    open_ = kept(open_.join(bound, ["q", "id"], "left").where("rest is null or s + coalesce(bound, 0) >= reached").select("q", "id", "s"))
    asked_for = kept(placed(open_, judged.where("common")))
    more = looked_up(asked_for)
    score = open_.select("q", "id", "s").unionByName(more).groupBy("q", "id").agg(F.sum("s").alias("score"))
    ranked = score.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id"))).where(F.col("ord") <= k)
    touched = asked_for.select("q", "term", "block").unionByName(tried_at.select("q", "term", "block")).distinct()
    looked = touched.join(blocks.select("term", "block", "n"), ["term", "block"]).groupBy("q").agg(F.sum("n").alias("n"))
    whole = judged.groupBy("q").agg(F.sum("df").alias("postings"), F.sum(F.when(~F.col("common") | F.col("seed"), F.col("df")).otherwise(0)).alias("read"))
    work = whole.join(looked, "q", "left").select(F.col("q").alias(query_id), "postings", (F.col("read") + F.coalesce("n", F.lit(0))).alias("read"))
    return ranked.select(F.col("q").alias(query_id), "id", "score", "ord"), work
