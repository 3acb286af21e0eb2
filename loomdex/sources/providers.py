"""Model providers as functions over Arrow batches: a pluggable embedding and extraction port."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(dimension: int = 64) -> Embed:
    """A deterministic provider for tests: counts of words by hash, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Embed, batch: int = 16, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``id_col, embedding``, ``batch`` texts a call; a provider that changes dimension or count fails the task."""

    def run(batches):
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for i in range(0, len(texts), batch):
                got = embed(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]) or len({len(v) for v in [*got, *out[:1]]}) > 1:
                    raise ValueError("the provider's answer doesn't fit its request")
                out += got
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return chunks.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(chunks.dtypes)[id_col]}, embedding array<float>")


def probe(embed: Embed, expected: int | None = None) -> dict[str, object]:
    """A provider's health: whether it answers, its dimension, and what is wrong, found with one short text."""
    try:
        got = embed(["dimension probe"])
        dimension = len(got[0]) if len(got) == 1 else 0
    except Exception as e:  # a provider that is down is a state, not a failure
        return {"healthy": False, "dimension": None, "error": type(e).__name__}
    error = "no_vector" if not dimension else "other_dimension" if expected not in (None, dimension) else None
    return {"healthy": error is None, "dimension": dimension or None, "error": error}
