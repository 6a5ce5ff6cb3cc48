"""Byte-level BPE through a sentencepiece model that is written from the vocabulary itself.

Every byte stands for one letter, so that a token is a word of such letters. A token of rank r becomes a piece of score -r:
sentencepiece merges the neighbours of highest score first, leftmost first, which is the order of ranks. The normaliser
leaves the letters alone. A text is cut by the pattern, each distinct match is encoded once and kept for a while, and ids
go back to bytes through the letters of their pieces. Encoding and decoding are narrow passes over Arrow batches.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.llm.vocabularies import read_ranks, send_file
from quillprint.session import ship_package

#: Matches a task remembers before it begins anew, and the longest one worth it.
REMEMBERED = 100_000
LONGEST_KEPT = 64
#: Bytes of a column that are worked on at once; one longer value is worked on alone.
RUN = 1 << 20
#: One letter per byte: a block of 256 letters without white space, case or composition.
FIRST_LETTER = 0x2800
LETTERS = {byte: chr(FIRST_LETTER + byte) for byte in range(256)}


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes([*out, number])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def to_letters(token: bytes) -> str:
    return token.decode("latin-1").translate(LETTERS)


def from_letters(piece: str) -> bytes:
    return bytes(ord(letter) - FIRST_LETTER for letter in piece)


def write_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is token i, scored -i; the unknown piece comes last.

    Field numbers are those of the public model format: pieces 1 (text 1, score 2, kind 3: 1 normal, 2 unknown), trainer 2
    (kind of model 3: 2 is BPE, size 4, unknown id 40), normaliser 3 (name 1, dummy prefix 3, extra blanks 4, escapes 5).
    Scores are single floats, which hold whole numbers up to 2 ** 24.
    """
    if len(tokens) >= 1 << 24:
        raise ValueError("Ranks above 2 ** 24 have no exact score")
    missing = [byte for byte in range(256) if bytes([byte]) not in set(tokens)]
    if missing:
        raise ValueError(f"The vocabulary lacks the bytes {missing}")
    pieces = b"".join(_piece(to_letters(token), -float(rank), 1) for rank, token in enumerate(tokens))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _piece("<unk>", 0.0, 2) + _bytes(2, trainer) + _bytes(3, normaliser)


def load_model(ranks: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=write_model(read_ranks(ranks)))


class Encoder:
    """Texts to ids."""

    def __init__(self, ranks: bytes, pattern: str, remembered: int = REMEMBERED):
        self.model = load_model(ranks)
        self.unknown = self.model.unk_id()
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. A match that is a token as a whole is that token."""
        cut = [self.cut(text) for text in texts]
        if len(self.known) > self.remembered:
            self.known = {}
        known, long = self.known, {}
        new = [match for match in {match for matches in cut for match in matches} if match not in known]
        letters = [to_letters(match.encode()) for match in new]
        for match, ids, whole in zip(new, self.model.encode(letters, num_threads=1), self.model.piece_to_id(letters)):
            ids = ids if whole == self.unknown else [whole]
            (known if len(match) <= LONGEST_KEPT else long)[match] = np.array(ids, "<u4").tobytes()
        if long:
            known = {**known, **long}
        return [b"".join(map(known.__getitem__, matches)) for matches in cut]


class Decoder:
    """Ids to bytes, by the letters of the model's pieces."""

    def __init__(self, ranks: bytes):
        model = load_model(ranks)
        self.tokens = [from_letters(model.id_to_piece(i)) for i in range(model.unk_id())]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids; an id that is no token is an error."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.tokens):
            raise ValueError(f"No token has the id {int(numbers.max())}")
        return b"".join(map(self.tokens.__getitem__, numbers.tolist()))


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(ranks, pattern)


@lru_cache(maxsize=2)
def decoder(ranks: bytes) -> Decoder:
    return Decoder(ranks)


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows of about RUN bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // RUN, prepend=0))
    edges = sorted({0, *starts.tolist(), len(sizes)})
    return list(zip(edges[:-1], edges[1:]))


def _map_column(docs: DataFrame, column: str, added: str, work, keep: bool) -> DataFrame:
    """``docs`` with one more binary column, computed from runs of values of ``column``."""
    ship_package(docs.sparkSession)
    docs = docs.drop(added)
    at = docs.columns.index(column)
    kept = [i for i in range(len(docs.columns)) if keep or i != at]
    names = [*(docs.columns[i] for i in kept), added]

    def run(batches):
        for batch in batches:
            for a, b in _runs(batch.column(at)):
                rows = batch.slice(a, b - a)
                made = pa.array(work(rows.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), made], names)

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(added, T.BinaryType())]))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "token_ids",
           keep: bool = True) -> DataFrame:
    """All columns of ``docs`` with the ids of ``text``, as little-endian unsigned 32-bit integers in a binary column.

    Every match of ``pattern`` is encoded by itself; what no match covers is left out, as in the library of the rank files.
    No special tokens. A null or empty text has no ids (an empty value, not null). A column named as ``into`` goes, and the
    text too unless ``keep``; all others stay, equal rows too. An empty table gives an empty one. A text is encoded whole,
    however long.
    """
    sent = send_file(docs.sparkSession, ranks_path)

    def work(texts):
        return encoder(sent.value, pattern).encode([x or "" for x in texts])

    return _map_column(docs, text, into, work, keep)


def decode(rows: DataFrame, ranks_path: str, ids: str = "token_ids", into: str = "decoded",
           keep: bool = True) -> DataFrame:
    """All columns of ``rows`` with the bytes that the ids stand for. Null ids give no bytes."""
    sent = send_file(rows.sparkSession, ranks_path)

    def work(values):
        return [decoder(sent.value).decode(x or b"") for x in values]

    return _map_column(rows, ids, into, work, keep)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, decoded from the ids that were written."""
    there = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern, keep=False), ranks_path)
    return there.select("doc_id", (F.length("token_ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
