"""Token states to one vector per probe."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.functions import vectors
from quillprint.session import settle

PROBE = ["model_name", "probe_idx"]
#: An id of one in so many tokens is hot; ids that the sketch of them tracks.
HOT_SHARE = 512
TRACKED = 16_384


def last_token(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """State at position ``sum(mask) - 1``, which is the last real token when padding is on the right.

    A probe without any real token yields its last position, as a negative index would.
    """
    keys = keys or PROBE
    count = F.sum("mask")
    place = F.when(count > 0, count - 1).otherwise(F.max("tok_idx"))
    wanted = states.groupBy(*keys).agg(place.cast("bigint").alias("tok_idx"))
    return (states.withColumn("tok_idx", F.col("tok_idx").cast("bigint")).join(wanted, [*keys, "tok_idx"])
            .select(*keys, F.col("state").alias("embedding")))


def masked_mean(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean state over real tokens; the divisor is at least 1e-9. One partial vector sum per task and probe."""
    keys = keys or PROBE
    masked = F.transform(vectors.as_doubles("state"), lambda x: x * F.col("mask"))
    summed = (states.select(*keys, F.col("mask").cast("double").alias("mask"), masked.alias("masked"))
              .groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("masked"))).alias("total"),
                                  F.greatest(F.sum("mask"), F.lit(1e-9)).alias("weight")))
    return summed.select(*keys, F.transform("total", lambda x: x / F.col("weight")).alias("embedding"))


def _hot_ids(tokens: DataFrame) -> list[int]:
    """Ids that hold at least one of HOT_SHARE tokens, by a sketch of bounded size; fewer than HOT_SHARE of them."""
    found = tokens.agg(F.expr(f"approx_top_k(token_id, {HOT_SHARE}, {TRACKED})").alias("top"),
                       F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found.top or [] if item["count"] * HOT_SHARE >= found.n]


def token_embeddings(texts: DataFrame, vocabulary: DataFrame, vocabulary_size: int,
                     padding_id: int | None = None, key: str = "text_id") -> DataFrame:
    """Vocabulary vector of every valid token, in place. Ids outside the vocabulary drop out and positions close up.

    An id that a large part of all tokens has would make one partition of a join by id. Such ids are found by a sketch, and
    their vectors, fewer than HOT_SHARE, are sent to the tokens; the other tokens meet theirs by a join. The sketch
    decides the way only, not the result.
    """
    valid = vectors.valid_tokens(F.col("token_ids"), vocabulary_size, padding_id)
    # written once, an array a text: the sketch and both joins read ids, which may be costly to make
    ids = settle(texts.select(key, valid.alias("ids")), "token-ids")
    tokens = ids.select(key, F.posexplode("ids").alias("pos", "token_id"))
    hot = _hot_ids(tokens)
    is_hot = F.col("token_id").isin(hot) if hot else F.lit(False)
    met = tokens.where(~is_hot).join(vocabulary.where(~is_hot), "token_id")
    if hot:
        met = met.unionByName(tokens.where(is_hot).join(F.broadcast(vocabulary.where(is_hot)), "token_id"))
    return met.select(key, "pos", "token_id", "embedding")
