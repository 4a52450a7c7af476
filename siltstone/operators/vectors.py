"""Embeddings: an injected encoder over Arrow batches, and unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import EmbedConfig

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimension: int) -> Encoder:
    """Signed word counts at hashed places: a stand-in for a model, the same everywhere."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[row, h % dimension] += 1 if h >> 63 else -1
        return out

    return encode


def embed(rows: DataFrame, make_encoder: Callable[[], Encoder], config: EmbedConfig = EmbedConfig(), text_col: str = "text") -> DataFrame:
    """Rows with ``embedding`` and ``embedding_ok``; a batch that fails is zeros, not an error."""

    @F.pandas_udf("struct<embedding:array<float>,ok:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()  # once for each worker
        for batch in batches:
            vectors, ok = [], []
            for at in range(0, len(batch), config.batch_size):
                texts = [t or "" for t in batch.iloc[at : at + config.batch_size]]
                try:
                    found, good = np.asarray(encoder(texts), dtype=np.float32), True
                except Exception:  # noqa: BLE001  one batch must not stop the others
                    found, good = np.zeros((len(texts), config.dimension), dtype=np.float32), False
                vectors += list(found)
                ok += [good] * len(texts)
            yield pd.DataFrame({"embedding": vectors, "ok": ok})

    got = rows.withColumn("_e", run(F.col(text_col)))
    return got.withColumns({"embedding": F.col("_e.embedding"), "embedding_ok": F.col("_e.ok")}).drop("_e")


def unit(vector: Column) -> Column:
    """The vector at length 1, in double; a vector of zeros stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(wide, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]
