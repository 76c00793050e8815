"""Text that models get, and steps that take a model as a plug-in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def context(hits: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """One row: the hits of a search as numbered lines; hits are a short list."""
    n = hits.withColumn("__n", F.row_number().over(W.orderBy(F.desc(score), F.asc(key))))
    line = F.concat(F.col("__n").cast("string"), F.lit(". "), F.col(name), F.lit(" ("), F.format_string("%.4f", score), F.lit(")"))
    return n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def report(name: Column, stores: Column, rating: Column) -> Column:
    return F.concat(F.lit("Khu "), name, F.lit(": "), stores.cast("string"), F.lit(" quán, điểm "), F.format_string("%.2f", rating))


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, embedding): unit vectors of texts by a model, called with whole batches; null texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                v = np.asarray(encode([prefix + x for x in part["t"]]), dtype=np.float32)
                v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
                yield pd.DataFrame({key: part["k"].to_numpy(), "embedding": list(v)})

    d = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def hashing_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """A model without weights: counts of words by hash, with signs."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        return out

    return encode
