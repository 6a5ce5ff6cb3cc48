"""Text encoders by name. An encoder turns a list of texts into a matrix, one row per text.

Real encoders are user code: register a factory, which is called once per Python worker. The one shipped here counts
hashed words; it is deterministic and needs no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.session import ship_package

Encode = Callable[[list[str]], np.ndarray]
ENCODER_BATCH = 32
_FACTORIES: dict[str, Callable[[int], Encode]] = {}


def register_encoder(name: str, factory: Callable[[int], Encode]) -> None:
    """``factory(width)`` builds the encoder inside a worker."""
    _FACTORIES[name] = factory


def _factory(name: str) -> Callable[[int], Encode]:
    if name not in _FACTORIES:
        raise ValueError(f"Unknown encoder: {name}. Known: {', '.join(_FACTORIES)}")
    return _FACTORIES[name]


def hashed_words(width: int) -> Encode:
    """Counts of words per bucket; the bucket of a word is the head of the md5 of its lower-cased form."""
    @lru_cache(maxsize=1 << 16)
    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:4], 16) % width

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for row, text in enumerate(texts):
            np.add.at(out[row], [bucket(w) for w in text.lower().split()], 1.0)
        return out

    return encode


register_encoder("hashed_words", hashed_words)


def encoder_udf(name: str, width: int):
    """The encoder as an Arrow function from text to ``array<float>``, built once per worker."""
    factory = _factory(name)

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = factory(width)
        for texts in batches:
            # only the texts of one call are Python strings at a time
            rows = [np.asarray(run([t or "" for t in texts.slice(start, ENCODER_BATCH).to_pylist()]), dtype=np.float32)
                    for start in range(0, len(texts), ENCODER_BATCH)]
            ends = np.cumsum([0] + [part.shape[1] for part in rows for _ in range(len(part))], dtype=np.int32)
            flat = np.concatenate([part.ravel() for part in rows]) if rows else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return encode


def encode_texts(df: DataFrame, column: str, encoder: str = "hashed_words", width: int = 64,
                 once_per_text: bool = False) -> DataFrame:
    """Adds ``embedding``. ``once_per_text`` encodes equal texts once, which pays when the encoder is expensive."""
    ship_package(df.sparkSession)
    encode = encoder_udf(encoder, width)
    if not once_per_text:
        return df.withColumn("embedding", encode(F.coalesce(F.col(column), F.lit(""))))
    keyed = df.withColumn("_text_key", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
    distinct = keyed.groupBy("_text_key").agg(F.first(column).alias("_text"))
    encoded = distinct.select("_text_key", encode(F.coalesce("_text", F.lit(""))).alias("embedding"))
    return keyed.join(encoded, "_text_key").drop("_text_key")
