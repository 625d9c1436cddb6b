"""Answering questions over an index, many at a time, and evaluating the answers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prompts
from ..functions.text import fill, shorten
from ..providers import SAFE_ANSWER, GenAIChatClient, GenAIEmbeddingClient, with_embedding, with_reply
from ..session import kept
from ..sources import keywords
from ..sources.index import LOCAL, MANAGED, attach_index, read_index
from ..sources.metrics_sink import log_to_mlflow, write_metrics
from . import evaluation
from .batching import count_batches, greedy_batches, joined_batches
from .ordering import head, head_or_all
from .qa import other_keys, qa_frame, qa_pairs
from .search import bm25, fuse, knn_l2_batch

CONTEXT_CHARS = 800
MODES = ("standard", "hybrid", "hyde")
#: Batches asked at first when pairs are capped.
FIRST_ROUND = 8


class Bm25Client:
    """Keyword search over the index's own texts, or over a keyword index of them that keywords.build() has stored."""

    def __init__(self, keyword_path: str | None = None):
        self.keyword_path = keyword_path

    def search_frame(self, index: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
        if self.keyword_path is None:
            return bm25(index, questions, top_k)
        found, _ = keywords.search(index.sparkSession, self.keyword_path, questions, top_k)
        return found.withColumnRenamed("id", "chunk_id")


def retrieve(
    index: DataFrame,
    questions: DataFrame,
    embedding_client: Any,
    mode: str = "standard",
    top_k: int = 5,
    chat_client: Any = None,
    keyword_client: Any = None,
    alpha: float = 0.5,
    semantic_score: str = "distance",
    max_tokens: int = 256,
) -> DataFrame:
    """(query_id, content, score, ord): the top_k texts for each (query_id, question).

    hyde embeds a passage that the chat model makes up in answer; hybrid fuses
    with keyword hits, if there is a keyword client.
    """
    asked = questions.select("query_id", "question")
    if mode == "hyde":
        asked = with_reply(asked, chat_client, "question", "sought", prompts.HYDE, max_tokens)
    else:
        asked = asked.withColumn("sought", F.col("question"))
    vectors = with_embedding(asked, embedding_client, "sought", "query_vector")
    near = knn_l2_batch(index, vectors, top_k).join(index.select("chunk_id", "content"), "chunk_id")
    near = near.select("query_id", "content", F.col("distance").alias("score"), "ord")
    if mode != "hybrid":
        return near
    if keyword_client is None:
        hits = near.limit(0)
    else:
        found = keyword_client.search_frame(index, questions, top_k)
        hits = found.join(index.select("chunk_id", "content"), "chunk_id").select("query_id", "content", "score", "ord")
    return fuse(near, hits, alpha, top_k, semantic_score)


def prompts_of(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, question, retrieved_docs, prompt): contexts shortened, in rank order."""
    short = hits.withColumn("short", shorten(F.col("content"), CONTEXT_CHARS))
    docs = short.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "content", "short"))).alias("hits"))
    none = F.array().cast("array<string>")
    return questions.join(docs, "query_id", "left").select(
        "query_id",
        "question",
        F.coalesce(F.transform("hits", lambda h: h["content"]), none).alias("retrieved_docs"),
        F.concat(
            F.lit("Context:\n"),
            F.array_join(F.coalesce(F.transform("hits", lambda h: h["short"]), none), "\n\n"),
            F.lit("\n\nQuestion: "),
            F.col("question"),
        ).alias("prompt"),
    )


class RAGInferencer:
    """Answers questions; a frame of them or one."""

    def __init__(self, embedding_client: Any, chat_client: Any, keyword_search_client: Any = None):
        self.embedding_client, self.chat_client, self.keyword_search_client = embedding_client, chat_client, keyword_search_client

    def infer_frame(
        self,
        questions: DataFrame,
        system_prompt: str = prompts.RAG,
        top_k: int = 5,
        max_tokens: int = 256,
        mode: str = "standard",
        index_type: str = LOCAL,
        index: Any = None,
        index_path: str | None = None,
        safe: str | None = None,
    ) -> DataFrame:
        """(query_id, question, retrieved_docs, answer) for (query_id, question)."""
        if index_type not in (LOCAL, MANAGED):
            raise ValueError(f"unknown index type {index_type!r}")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
        if mode == "hybrid" and index_type == MANAGED:
            raise NotImplementedError("hybrid search needs a local index")
        spark = questions.sparkSession
        table = read_index(spark, index_path) if index_type == LOCAL else attach_index(spark, index)
        hits = retrieve(
            table, questions, self.embedding_client, mode, top_k, self.chat_client, self.keyword_search_client, max_tokens=max_tokens
        )
        asked = prompts_of(questions.select("query_id", "question"), hits)
        answered = with_reply(asked, self.chat_client, "prompt", "answer", system_prompt, max_tokens, safe)
        return answered.select("query_id", "question", "retrieved_docs", "answer")

    def infer(
        self,
        system_prompt: str,
        question: str,
        top_k: int = 5,
        max_tokens: int = 256,
        mode: str = "standard",
        index_type: str = LOCAL,
        index: Any = None,
        index_path: str | None = None,
        *,
        spark: SparkSession | None = None,
        safe: str | None = None,
    ) -> DataFrame:
        """One row (retrieved_docs, question, answer). A local index that isn't there is a FileNotFoundError."""
        spark = spark or SparkSession.active()
        one = spark.createDataFrame([(0, question)], "query_id long, question string")
        found = self.infer_frame(one, system_prompt, top_k, max_tokens, mode, index_type, index, index_path, safe)
        return found.select("retrieved_docs", "question", "answer")


class RAGInferenceRunner:
    """A local index's answers from provider names alone."""

    def __init__(
        self,
        embedding_provider: str,
        embedding_model: str,
        chat_provider: str,
        chat_model: str,
        api_key: str | None = None,
        api_version: str | None = None,
        azure_endpoint: str | None = None,
        base_url: str | None = None,
    ):
        shared = {"api_key": api_key, "api_version": api_version, "azure_endpoint": azure_endpoint, "base_url": base_url}
        self.inferencer = RAGInferencer(
            GenAIEmbeddingClient(embedding_provider, embedding_model, **shared), GenAIChatClient(chat_provider, chat_model, **shared)
        )

    def run_inference(self, question: str, index_path: str, system_prompt: str | None = None, top_k: int = 5, mode: str = "standard") -> DataFrame:
        return self.inferencer.infer(system_prompt or prompts.RAG, question, top_k=top_k, mode=mode, index_path=index_path)


class RagEvalDataPrep:
    """Answers for a frame of questions."""

    def __init__(self, inferencer: RAGInferencer, system_prompt: str, index_type: str, index_path: str | None = None, index: Any = None):
        self.inferencer, self.system_prompt = inferencer, system_prompt
        self.where = {"index_type": index_type, "index_path": index_path, "index": index}

    def run_rag(self, input_df: DataFrame, top_k: int = 5, limit: int | None = None, mode: str = "standard", order_col: str | None = None) -> DataFrame:
        """input_df with `answer`; a failed call answers SAFE_ANSWER. limit keeps the first rows, by order_col or as they come, 0 none."""
        if "question" not in input_df.columns:
            raise ValueError("the frame needs a column 'question'")
        rows = head(input_df, order_col, limit)
        distinct = rows.select("question").where(F.col("question").isNotNull()).distinct()
        asked = distinct.withColumn("query_id", F.xxhash64("question"))
        answers = self.inferencer.infer_frame(asked, self.system_prompt, top_k, mode=mode, safe=SAFE_ANSWER, **self.where)
        return rows.join(answers.select("question", "answer"), "question", "left")


class EvalDatasetGroundTruthGenerator:
    """Question and answer pairs from texts."""

    def __init__(self, chat_client: Any):
        self.chat_client = chat_client

    def count_batches(self, df: DataFrame, text_column: str = "content", max_chars: int = 10_000, order_col: str = "doc_seq") -> int:
        return count_batches(df, text_column, max_chars, order_col)

    def process_dataframe(
        self,
        df: DataFrame,
        text_column: str = "content",
        max_chars: int = 10_000,
        prompt_template: str = "",
        max_total_pairs: int | None = None,
        order_col: str = "doc_seq",
    ) -> DataFrame:
        """(question, ground truth, and whatever else replies name). Batches whose call or reply fails give no pairs.

        With max_total_pairs batches are asked in order, a round of them at a
        time, twice as many each round, until there are so many pairs.
        """
        batches = kept(joined_batches(greedy_batches(df, text_column, order_col, max_chars), order_col))
        template, pairs, begin, size = prompt_template or prompts.QA_GENERATION, None, 0, FIRST_ROUND
        last = batches.agg(F.max("batch")).first()[0]
        while pairs is None or begin <= (-1 if last is None else last):
            some = batches if max_total_pairs is None else batches.where(F.col("batch").between(begin, begin + size - 1))
            asked = some.withColumn("prompt", fill(template, context=F.col("content")))
            replies = kept(with_reply(asked, self.chat_client, "prompt", "reply", max_tokens=3000, error_col="error"))
            found = qa_pairs(replies)
            pairs = found if pairs is None else pairs.unionByName(found)
            if max_total_pairs is None or pairs.limit(max_total_pairs).count() >= max_total_pairs:
                break
            begin, size = begin + size, 2 * size
        if max_total_pairs is not None:
            pairs = kept(pairs.orderBy("batch", "pos").limit(max_total_pairs))
        return qa_frame(pairs, other_keys(pairs))


class RagEvaluator:
    """Scores answers by BLEU and by a judge."""

    def __init__(self, chat_client: Any, experiment_name: str, sink_path: str | None = None, mlflow: bool = False):
        self.chat_client, self.experiment_name, self.sink_path, self.mlflow = chat_client, experiment_name, sink_path, mlflow

    def evaluate(self, input_df: DataFrame, prompt: str | None = None, max_rows: int | None = None, order_col: str | None = None) -> tuple[DataFrame, dict]:
        """The frame with scores, and a dict of metrics (None for an empty frame). max_rows of 0 means all."""
        rows = head_or_all(input_df, order_col, max_rows)
        asked = rows.withColumn(
            "_prompt",
            fill(prompt or prompts.EVALUATION, ground_truth=F.col("`ground truth`"), generated_answer=F.col("answer")),
        )
        replied = with_reply(asked, self.chat_client, "_prompt", "_reply")
        scored = evaluation.with_scores(replied, F.col("_reply")).drop("_prompt", "_reply")
        scored = kept(scored)  # the judge is asked once: metrics, size and frame all read this
        row = evaluation.metrics(scored)
        found, size = row.first().asDict(), scored.count()
        if self.sink_path:
            write_metrics(row, self.experiment_name, size, self.sink_path)
        if self.mlflow:
            log_to_mlflow(found, self.experiment_name, size)
        return scored, found


