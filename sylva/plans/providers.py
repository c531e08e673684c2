"""What stands in for language models, embedders and rerankers: one interface, and deterministic defaults.

A provider maps a batch of inputs to outputs. It runs in Arrow batches on the workers; a failing item gives a text
beginning with `Error:` and never fails the job. Each is tried three times.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

TRIES = 3


class TextProvider(ABC):
    @abstractmethod
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class Embedder(ABC):
    dim: int

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(ABC):
    @abstractmethod
    def score(self, query: str, texts: Sequence[str]) -> list[float]: ...

    def score_table(self, queries: Sequence[str], texts: Sequence[str], wanted: np.ndarray, batch: int = 4) -> np.ndarray:
        """The scores of texts (rows) for queries (columns), those that are wanted: a query's texts go to it `batch` at a time."""
        out = np.zeros(wanted.shape)
        for q in np.nonzero(wanted.any(0))[0]:
            at = np.nonzero(wanted[:, q])[0]
            for i in range(0, len(at), batch):
                out[at[i : i + batch], q] = self.score(queries[q], [texts[j] for j in at[i : i + batch]])
        return out


class FirstSentence(TextProvider):
    """Answers with the first sentence of what follows the last blank line of a prompt."""

    def complete(self, prompts):
        return [p.rsplit("\n\n", 1)[-1].split(". ")[0].strip() for p in prompts]


class HashedWords(Embedder):
    """Unit vectors of signed hashed words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class SharedWords(Reranker):
    """The share of a query's words that a text holds."""

    def score(self, query, texts):
        asked = set(query.lower().split())
        return [len(asked & set((t or "").lower().split())) / max(1, len(asked)) for t in texts]

    def score_table(self, queries, texts, wanted, batch=4):
        """Of all queries at once: each text is split once, and its words lead to the queries that hold them."""
        asked = [set(q.lower().split()) for q in queries]
        holding: dict[str, list[int]] = {}
        for i, words in enumerate(asked):
            for w in words:
                holding.setdefault(w, []).append(i)
        known, sizes = set(holding), np.maximum(1, [len(words) for words in asked])
        out = np.zeros((len(texts), len(queries)))
        for row, text in zip(out, texts, strict=True):
            found = [i for w in known & set((text or "").lower().split()) for i in holding[w]]
            row[:] = np.bincount(found, minlength=len(queries)) / sizes if found else 0.0
        return out


def _answers(provider: TextProvider, prompts: Sequence[str]) -> list[str]:
    """A provider's outputs for a batch; if the batch fails, or has too few or many outputs, each prompt's own, or its error."""
    error: Exception | str = "no output"
    for _ in range(TRIES if len(prompts) == 1 else 1):
        try:
            found = list(provider.complete(prompts))
            if len(found) == len(prompts):
                return found
            error = f"{len(found)} outputs for {len(prompts)} prompts"
        except Exception as e:  # a model's failure is an answer, not the end of the job
            error = e
    if len(prompts) > 1:
        return [_answers(provider, [p])[0] for p in prompts]
    return [f"Error: {error}"] * len(prompts)


def complete(rows: DataFrame, prompt: str, out: str, provider: TextProvider, batch: int = 64) -> DataFrame:
    """rows with a provider's outputs for the prompts in a column."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(frames):
        for frame in frames:
            prompts, found = frame[prompt].fillna("").tolist(), []
            for i in range(0, len(prompts), batch):
                found += _answers(provider, prompts[i : i + batch])
            yield frame.assign(**{out: found})

    return rows.mapInPandas(run, f"{kinds}, `{out}` string")


def embed(rows: DataFrame, text: str, out: str, provider: Embedder) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(frames):
        for frame in frames:
            yield frame.assign(**{out: list(provider.embed(frame[text].fillna("").tolist()))})

    return rows.mapInPandas(run, f"{kinds}, `{out}` array<double>")


def rerank(rows: DataFrame, query: str, text: str, out: str, provider: Reranker, batch: int = 4) -> DataFrame:
    """rows (query, text) with the provider's score of each pair: pairs of one query go to it `batch` at a time, in their order."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(frames):
        for frame in frames:
            queries, texts, scores = frame[query].fillna("").tolist(), frame[text].fillna("").tolist(), np.zeros(len(frame))
            places: dict[str, list[int]] = {}
            for i, q in enumerate(queries):
                places.setdefault(q, []).append(i)
            for q, at in places.items():
                for i in range(0, len(at), batch):
                    part = at[i : i + batch]
                    scores[part] = provider.score(q, [texts[j] for j in part])
            yield frame.assign(**{out: scores})

    return rows.mapInPandas(run, f"{kinds}, `{out}` double")
