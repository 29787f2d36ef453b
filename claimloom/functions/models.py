"""Embedding and reranking models by specification string, with offline stand-ins.

A specification is a preset's name or `provider:name`. Providers are registries of loaders: a loader runs once in each
worker, in the Arrow batches of the expression that its model is wrapped into. What a loader needs beyond this package is
imported only then, so a model that can't be had is told when it is used, not when it is named.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import hashing_embedding

# Short names of public models, and the prefix that models of the BGE family expect before a query.
EMBEDDING_PRESETS = {
    "minilm": "st:sentence-transformers/all-MiniLM-L6-v2",
    "mpnet": "st:sentence-transformers/all-mpnet-base-v2",
    "bge-small": "st:BAAI/bge-small-en-v1.5",
    "bge-base": "st:BAAI/bge-base-en-v1.5",
    "e5-small": "st:intfloat/e5-small-v2",
    "gte-small": "st:thenlper/gte-small",
    "openai-small": "openai:text-embedding-3-small",
    "openai-large": "openai:text-embedding-3-large",
}
RERANKER_PRESETS = {
    "ce-minilm": "cross-encoder:cross-encoder/ms-marco-MiniLM-L-6-v2",
    "ce-minilm-12": "cross-encoder:cross-encoder/ms-marco-MiniLM-L-12-v2",
    "ce-electra": "cross-encoder:cross-encoder/ms-marco-electra-base",
    "bge-reranker": "cross-encoder:BAAI/bge-reranker-base",
    "bge-reranker-large": "cross-encoder:BAAI/bge-reranker-large",
    "llm-mini": "llm:gpt-5.4-mini",
    "llm-nano": "llm:gpt-5.4-nano",
    "llm": "llm:gpt-5.4-mini",
    "off": "none",
}
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

Vectors = Callable[[list[str]], list[list[float]]]
Scores = Callable[[list[tuple[str, str]]], list[float]]
BATCH = {"st": 64, "openai": 128, "cross-encoder": 32}


def _sentence_transformer(name: str) -> Vectors:
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(name, trust_remote_code=False)
    return lambda texts: model.encode(texts, normalize_embeddings=True, show_progress_bar=False).tolist()


def _hosted_embedding(name: str) -> Vectors:
    from openai import OpenAI

    if not os.environ.get("OPENAI_API_KEY"):
        raise RuntimeError("OPENAI_API_KEY is not set")
    client = OpenAI(max_retries=5, timeout=60.0)

    def embed(texts: list[str]) -> list[list[float]]:
        answer = client.embeddings.create(model=name, input=[t if t.strip() else " " for t in texts])
        return [d.embedding for d in sorted(answer.data, key=lambda d: d.index)]  # items may come in any order

    return embed


def _cross_encoder(name: str) -> Scores:
    from sentence_transformers import CrossEncoder

    model = CrossEncoder(name)
    return lambda pairs: [float(s) for s in model.predict(pairs, show_progress_bar=False)]


def _hosted_grader(name: str) -> Callable[[str, list[str]], str]:
    from openai import OpenAI

    client = OpenAI(max_retries=5, timeout=60.0)

    def ask(query: str, texts: list[str]) -> str:
        listed = "\n".join(f"{i}: {t}" for i, t in enumerate(texts))
        prompt = f'Grade how relevant each passage is to the query, from 0 (not) to 3 (fully). Answer with a JSON list of {{"id": number, "score": grade}}.\nQuery: {query}\n{listed}'
        return client.chat.completions.create(model=name, messages=[{"role": "user", "content": prompt}]).choices[0].message.content

    return ask


_EMBEDDERS: dict[str, Callable[[str], Vectors]] = {"st": _sentence_transformer, "openai": _hosted_embedding}
_PAIR_MODELS: dict[str, Callable[[str], Scores]] = {"cross-encoder": _cross_encoder}
_GRADERS: dict[str, Callable[[str], Callable[[str, list[str]], str]]] = {"llm": _hosted_grader}


def register_loader(provider: str, load: Callable[[str], Vectors]) -> None:
    """Makes `provider:name` usable as an embedder; load(name) gives a function from texts to vectors."""
    _EMBEDDERS[provider] = load


def register_pair_model(kind: str, load: Callable[[str], Scores]) -> None:
    """Makes `kind:name` usable as a reranker; load(name) gives a function from (query, text) pairs to scores."""
    _PAIR_MODELS[kind] = load


def register_grader(kind: str, load: Callable[[str], Callable[[str, list[str]], str]]) -> None:
    """Makes `kind:name` usable as a reranker; load(name) gives a function from a query and texts to a JSON list of grades."""
    _GRADERS[kind] = load


def _known(spec: str, presets: dict[str, str], kinds: set[str], what: str) -> tuple[str, str]:
    kind, colon, name = presets.get(spec, spec).partition(":")
    if kind not in kinds or (colon and not name):
        raise ValueError(f"unknown {what} {spec!r}: one of {sorted(presets)}, or a name after one of {sorted(kinds)} and a colon")
    return kind, name


def parse_spec(spec: str) -> tuple[str, str]:
    """(provider, name) of an embedder; raises ValueError for what no provider knows."""
    provider, name = _known(spec, EMBEDDING_PRESETS, {"hashing", *_EMBEDDERS}, "embedder")
    if not name and provider != "hashing":
        raise ValueError(f"{provider} needs a model's name")
    return provider, name or "32"


def embedder(spec: str, batch: int | None = None, queries: bool = False) -> Callable[[Column], Column]:
    """A column expression from text to vector: `hashing:32` natively, any other provider through Arrow batches.

    queries: whether the texts are queries, which some models want with a prefix.
    """
    provider, name = parse_spec(spec)
    if provider == "hashing":
        return lambda c: hashing_embedding(c, int(name))
    load, size = _EMBEDDERS[provider], batch or BATCH.get(provider, 64)
    prefix = QUERY_PREFIX if queries and "bge" in name else ""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(name)
        for s in batches:
            texts = [prefix + t if t and t.strip() else " " for t in s]
            yield pd.Series([v for i in range(0, len(texts), size) for v in model(texts[i : i + size])])

    return run


def reranker(spec: str, model=None) -> Callable[[DataFrame], DataFrame]:
    """A function that gives hits (query_id, query, text, rank, ...) a rerank_score; raises ValueError for an unknown one.

    `none` keeps the order, `overlap` is an offline stand-in, `cross-encoder:name` a pair model, `llm:name` a graded
    language model, `ltr` a trained ranking model, which must be given.
    """
    from claimloom.operators import rerank as R

    kind, name = _known(spec, RERANKER_PRESETS, {"none", "overlap", "ltr", *_PAIR_MODELS, *_GRADERS}, "reranker")
    if kind == "none":
        return lambda hits: hits.withColumn("rerank_score", R.identity_score())
    if kind == "overlap":
        return lambda hits: hits.withColumn("rerank_score", R.overlap_score())
    if kind == "ltr":
        if model is None:
            raise ValueError("ltr needs a trained model")
        from claimloom.operators.ltr import score_with_model

        return lambda hits: score_with_model(model, hits)
    if kind in _PAIR_MODELS:
        load, size = _PAIR_MODELS[kind], BATCH.get(kind, 32)
        score = R.pair_model_score(lambda: load(name), size)
        return lambda hits: hits.withColumn("rerank_score", score(F.col("query"), F.col("text")))
    load_grader = _GRADERS[kind]
    return lambda hits: R.model_grades(hits, lambda: load_grader(name))
