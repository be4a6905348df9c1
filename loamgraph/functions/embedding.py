"""Embedding providers. A provider turns a text column into an array<float> column; empty arrays mean no embedding."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgraph.functions.ids import let

Provider = Callable[[Column], Column]


def null_embedding(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array().cast("array<float>")).otherwise(F.array().cast("array<float>"))


def hashing_embedding(dimensions: int = 64) -> Provider:
    """Deterministic and offline: words hashed to signed components, scaled to length 1. Built-in functions only."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        component = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dimensions)) == i), F.lit(0.0), lambda a, h: a + sign(h))
        raw = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: component(hs, i)))
        return let(raw, scaled)

    return embed


def scaled(raw: Column) -> Column:
    """To length 1; zeros stay."""
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return let(F.when(length > 0, length).otherwise(1.0), lambda n: F.transform(raw, lambda x: (x / n).cast("float")))


def batch_embedding(embed_batch: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Provider:
    """A model or service called with batches of texts, in Arrow batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                piece = texts.iloc[at : at + batch].fillna("").tolist()
                got = embed_batch(piece)
                if len(got) != len(piece):
                    raise ValueError("the provider returned another number of embeddings than of texts")
                out += got
            yield pd.Series(out)

    return run


def remote_embedding(model: str, key: str, url: str, opener: Callable | None = None, batch: int = 64, timeout: float = 120.0) -> Provider:
    """A service that takes {"model", "input"} by POST with a bearer token and answers {"data": [{"index", "embedding"}]}."""

    def ask(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(url, data=body, headers={"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with (opener or urllib.request.urlopen)(request, timeout=timeout) as answer:
                data = json.loads(answer.read())["data"]
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"the embedding service answered {e.code}: {e.read().decode(errors='replace')[:500]}") from e
        return [d["embedding"] for _, d in sorted(enumerate(data), key=lambda x: x[1].get("index", x[0]))]

    return batch_embedding(ask, batch)


#: Models that this Python worker has loaded.
_LOADED: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def local_embedding(name: str, load: Callable[[str], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> Provider:
    """A model loaded by ``load(name)`` once in each Python worker."""

    def embed(texts: list[str]) -> list[list[float]]:
        if name not in _LOADED:
            _LOADED[name] = load(name)
        return _LOADED[name](texts)

    return batch_embedding(embed, batch)


def provider_from_environment(
    remote: Callable[[], Provider] | None = None, local: Callable[[], Provider] | None = None, key: str = "EMBEDDING_API_KEY",
    model: str = "EMBEDDING_LOCAL_MODEL",
) -> Provider:
    """A remote provider if a key is set, else a local model if one is named, else none."""
    if os.environ.get(key) and remote:
        return remote()
    if os.environ.get(model) and local:
        return local()
    return null_embedding
