"""Where evaluation metrics go: a Parquet table, or MLflow where it is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, experiment: str, size: int, path: str) -> None:
    """Append the metrics row with experiment, evaluation_size and total_questions."""
    row = metrics.withColumns(
        {"experiment": F.lit(experiment), "evaluation_size": F.lit(size), "total_questions": F.lit(size)}
    )
    row.write.mode("append").parquet(path)


def log_to_mlflow(metrics: dict, experiment: str, size: int, tracking_uri: str = "databricks") -> None:
    import mlflow

    mlflow.set_tracking_uri(tracking_uri)
    mlflow.set_experiment(experiment)
    with mlflow.start_run():
        mlflow.log_metrics({k: v for k, v in metrics.items() if v is not None})
        mlflow.log_params({"evaluation_size": size, "total_questions": size})
