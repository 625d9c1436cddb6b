"""Vector indexes as ordinary tables: a Parquet folder, or a named view with upserts by id."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_corpus, managed_rows
from ..operators.ordering import with_position
from ..providers import with_embedding
from . import managed

INDEX_SCHEMA = "chunk_id long, content string, embedding array<float>"
MANAGED_SCHEMA = "id int, content string, embedding array<float>"
UPSERT_BATCH = 200
LOCAL, MANAGED = "local_index", "databricks_vector_index"
MANAGED_KEYS = ("catalog", "schema", "endpoint_name", "embedding_dim", "index_name")


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """A local index; FileNotFoundError where there is none."""
    if index_path is None:
        raise FileNotFoundError("a local index needs index_path")
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(index_path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no index at {index_path}") from None
        raise


def attach_index(spark: SparkSession, index: str | DataFrame | None) -> DataFrame:
    """A managed index by name or as a table already open; content and embedding are what searches read."""
    if index is None:
        raise ValueError("a managed index needs the index to search")
    found = spark.table(index) if isinstance(index, str) else index
    return found.withColumnRenamed("id", "chunk_id") if "id" in found.columns else found


def upsert_batches(records: DataFrame, id_col: str = "id", batch_size: int = UPSERT_BATCH) -> DataFrame:
    """records with the number of the upsert batch each belongs to, by position in id order."""
    return with_position(records, id_col, "_at").withColumn("batch", F.floor(F.col("_at") / batch_size)).drop("_at")


def upserted(existing: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """existing with records written over rows of the same id."""
    return existing.join(records.select(id_col), id_col, "left_anti").unionByName(records)


class VectorEmbedding:
    """Builds indexes: chunk, embed, write."""

    def __init__(self, embedding_client: Any, chunk_size: int, overlap: int):
        self.embedding_client, self.chunk_size, self.overlap = embedding_client, chunk_size, overlap

    def generate_local_index(self, df: DataFrame, text_column: str, index_path: str, order_col: str = "doc_seq") -> tuple[str, DataFrame]:
        """Chunk the joined corpus, embed the chunks, write them; the path and the chunks. No text: an empty index."""
        chunks = chunk_corpus(df, text_column, order_col, self.chunk_size, self.overlap)
        with_embedding(chunks, self.embedding_client, "content").write.mode("overwrite").parquet(index_path)
        return index_path, read_index(df.sparkSession, index_path).select("chunk_id", "content")

    def generate_managed_index(
        self,
        df: DataFrame,
        content_column: str,
        catalog: str,
        schema: str,
        endpoint_name: str,
        embedding_dim: int,
        index_name: str,
        order_col: str = "doc_seq",
        id_offset: int = 0,
    ) -> None:
        """Embed texts unchunked and upsert them, by id from id_offset, into {catalog}.{schema}.{endpoint}_{index}.

        An empty catalog leaves that part out. Null and blank texts are left out.
        managed.py tells how little an upsert writes.
        """
        spark = df.sparkSession
        name = ".".join(p for p in (catalog, schema, f"{endpoint_name}_{index_name}") if p)
        rows = with_position(managed_rows(df, content_column, order_col), "ord", "id", id_offset)
        records = with_embedding(rows.select(F.col("id").cast("int").alias("id"), "content"), self.embedding_client, "content")
        try:
            checked = records.withColumn(
                "embedding",
                F.when(F.size("embedding") == embedding_dim, F.col("embedding")).otherwise(
                    F.raise_error(F.lit(f"vectors must have {embedding_dim} components"))
                ),
            )
            managed.upsert(spark, name, checked)
        except Exception as e:
            raise RuntimeError(f"upsert into {name} failed: {e}") from e

    def generate_index(self, df: DataFrame, text_column: str, index_path: str | None = None, vector_index_type: str = LOCAL, **kwargs):
        """Either kind of index; see there."""
        if vector_index_type == LOCAL:
            if not index_path:
                raise ValueError("a local index needs index_path")
            return self.generate_local_index(df, text_column, index_path, **kwargs)
        if vector_index_type == MANAGED:
            if missing := [k for k in MANAGED_KEYS if k not in kwargs]:
                raise ValueError(f"a managed index also needs {', '.join(missing)}")
            return self.generate_managed_index(df, text_column, **kwargs)
        raise ValueError(f"unknown index type {vector_index_type!r}")
