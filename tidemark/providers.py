"""Embedding and chat models as Spark calls them: configured on the driver, opened on workers.

A client is a small picklable configuration. The model or connection behind it
is opened lazily in the process that calls it, and secrets that aren't given
are read from that process's environment. Providers whose packages aren't
installed fail only when called.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import prompts
from .functions.vectors import HASH_DIM, hash_vector

EMBED_PROVIDERS = ("databricks", "azure-openai", "openai", "ollama", "sentence-transformer", "hash")
CHAT_PROVIDERS = ("databricks", "azure-openai", "openai", "ollama", "stub")
#: Failed calls answer with this, so that one bad question doesn't end a batch.
SAFE_ANSWER = "Error generating answer"


def _open_api(c: Any) -> Any:
    """An OpenAI-compatible API client."""
    import openai

    key = c.api_key or os.environ.get("TIDEMARK_API_KEY") or os.environ.get("OPENAI_API_KEY")
    if c.provider == "azure-openai":
        return openai.AzureOpenAI(api_key=key, api_version=c.api_version, azure_endpoint=c.azure_endpoint)
    if c.provider == "ollama":
        return openai.OpenAI(base_url=c.base_url or "http://localhost:11434/v1", api_key=key or "ollama")
    return openai.OpenAI(api_key=key, **({"base_url": c.base_url} if c.base_url else {}))


@dataclass
class _Client:
    provider: str
    model: str = ""
    base_url: str | None = None
    api_key: str | None = field(default=None, repr=False)
    api_version: str | None = None
    azure_endpoint: str | None = None

    def _check(self, known: tuple[str, ...], kind: str) -> None:
        """Provider names count in any case; what a provider needs is missed here and not by the first task that calls it."""
        self.provider = (self.provider or "").lower()
        if self.provider not in known:
            raise ValueError(f"unknown {kind} provider {self.provider!r}; one of {known}")
        key = self.api_key or os.environ.get("TIDEMARK_API_KEY") or os.environ.get("OPENAI_API_KEY")
        if self.provider == "azure-openai" and not (key and self.api_version and self.azure_endpoint):
            raise ValueError("azure-openai needs api_key, api_version and azure_endpoint")
        if self.provider in ("openai", "databricks") and not key:
            raise ValueError(f"{self.provider} needs api_key")
        if self.provider == "databricks" and not self.base_url:
            raise ValueError("databricks needs base_url")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_opened"}


@dataclass
class GenAIEmbeddingClient(_Client):
    """Text to vectors. Provider "hash" needs no model and is what tests use."""

    device: str = "cpu"
    dim: int = HASH_DIM

    def __post_init__(self) -> None:
        self._check(EMBED_PROVIDERS, "embedding")

    def _call(self, texts: list[str]) -> list[list[float]]:
        if self.provider == "hash":
            return [hash_vector(t, self.dim) for t in texts]
        if not hasattr(self, "_opened"):
            if self.provider == "sentence-transformer":
                from sentence_transformers import SentenceTransformer

                self._opened = SentenceTransformer(self.model, device=self.device)
            else:
                self._opened = _open_api(self)
        if self.provider == "sentence-transformer":
            return [list(map(float, v)) for v in self._opened.encode(texts, batch_size=len(texts))]
        return [d.embedding for d in self._opened.embeddings.create(model=self.model, input=texts).data]

    def generate_embedding(
        self, input_texts: list[str] | str, batch_size: int = 16, max_retries: int = 5, backoff_factor: float = 5.0
    ) -> list[list[float]]:
        """Vectors of texts, in batches. Only rate limits are tried again, waiting twice as long each time."""
        texts = [input_texts] if isinstance(input_texts, str) else list(input_texts)
        out: list[list[float]] = []
        for i in range(0, len(texts), batch_size):
            for attempt in range(max_retries + 1):
                try:
                    out += self._call(texts[i : i + batch_size])
                    break
                except Exception as e:
                    if not ("429" in str(e) or "rate limit" in str(e).lower()):
                        raise
                    time.sleep(backoff_factor * 2**attempt)
            else:
                raise RuntimeError(f"rate limit held through {max_retries + 1} attempts")
        return out


@dataclass
class GenAIChatClient(_Client):
    """Messages to a reply. Provider "stub" answers from `replies` (by substring of the last message) or echoes."""

    system_prompt: str = prompts.SYSTEM
    replies: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._check(CHAT_PROVIDERS, "chat")

    def chat(
        self,
        user_input: str | list[dict],
        system_prompt: str | None = None,
        max_tokens: int = 1024,
        temperature: float = 1.0,
        top_k: float = 1.0,
    ) -> str:
        """The reply to a text, or to messages taken as they are. top_k is accepted and not passed on."""
        messages = (
            [{"role": "system", "content": system_prompt or self.system_prompt}, {"role": "user", "content": user_input}]
            if isinstance(user_input, str)
            else user_input
        )
        if self.provider == "stub":
            last = messages[-1]["content"]
            return next((r for part, r in self.replies.items() if part in last), last[:max_tokens])
        if not hasattr(self, "_opened"):
            self._opened = _open_api(self)
        reply = self._opened.chat.completions.create(
            model=self.model, messages=messages, max_tokens=max_tokens, temperature=temperature
        )
        return reply.choices[0].message.content or ""


def with_embedding(df: DataFrame, client: Any, text_col: str, out_col: str = "embedding", batch_size: int = 16) -> DataFrame:
    """df with a float vector for each text. Null texts have a null vector.

    Calls are batched within Arrow batches. Write the result before using it
    twice: lost tasks call the model again.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch[text_col].notna()
            vectors = iter(client.generate_embedding(batch.loc[given, text_col].tolist(), batch_size=batch_size) if given.any() else [])
            yield batch.assign(**{out_col: [next(vectors) if ok else None for ok in given]})

    return df.mapInPandas(run, schema)


def with_reply(
    df: DataFrame,
    client: Any,
    prompt_col: str,
    out_col: str = "reply",
    system_prompt: str | None = None,
    max_tokens: int = 1024,
    safe: str | None = None,
    error_col: str | None = None,
) -> DataFrame:
    """df with a chat reply for each prompt; null prompts have none.

    With safe, a failed call gives that text (and its message in error_col)
    instead of failing the task; without, with error_col, it gives null.
    """
    extra = [T.StructField(out_col, T.StringType())] + ([T.StructField(error_col, T.StringType())] if error_col else [])
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch[prompt_col]:
                reply = error = None
                if prompt is not None:
                    try:
                        reply = client.chat(prompt, system_prompt=system_prompt, max_tokens=max_tokens)
                    except Exception as e:
                        if safe is None and error_col is None:
                            raise
                        reply, error = safe, str(e)
                replies.append(reply)
                errors.append(error)
            out = batch.assign(**{out_col: replies})
            yield out.assign(**{error_col: errors}) if error_col else out

    return df.mapInPandas(run, schema)
