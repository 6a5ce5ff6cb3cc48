"""Files of public tokenizers: read on the driver, held to a size, sent to every task."""

from __future__ import annotations

import base64

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Bytes that a vocabulary file may have to be broadcast.
LARGEST = 64 << 20


def send_file(spark: SparkSession, path: str, largest: int = LARGEST) -> Broadcast:
    """A file of the driver's machine as broadcast bytes; one above ``largest`` is refused."""
    with open(path, "rb") as file:
        content = file.read(largest + 1)
    if len(content) > largest:
        raise ValueError(f"{path} has more than {largest} bytes")
    return spark.sparkContext.broadcast(content)


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 token and rank. Ranks have to be 0, 1, 2, ..."""
    ranks = {}
    for line in content.splitlines():
        if line:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("The ranks of a vocabulary have to be dense")
    return [ranks[i] for i in range(len(ranks))]
