"""Token ids of two tokenizers lined up by the bytes they cover.

A is a byte-level BPE (``tokenizers``), B a sentencepiece model. After both have encoded a whole text, an anchor is a byte
offset where a token of either ends and where the next token of either begins with a space. Anchors cut a document into
windows, and a window's alignment follows from its two tuples of ids alone: each distinct window is aligned once and
remembered. Ids met by bytes are links; how often a pair of ids is linked in the whole corpus tells a document's best links.

The counts are exact and no table of pairs is sent to all tasks. Documents are gathered in blocks; a block sends each of its
distinct pairs once, with its count, and gets the corpus's count back by joins on the pair. So a pair that half of all links
have is one row per block, and a block's rows are bounded by its size.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.llm.vocabularies import send_file
from quillprint.session import settle, ship_package

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 20
#: Words and windows that a task remembers before it begins anew, and the longest word worth it.
REMEMBERED = 100_000
LONGEST_KEPT = 64
#: Words that the tokenizers are handed at once: what they return is far larger than the ids.
ENCODED = 4096
#: Where a text may be cut before it is encoded: a single space between others than white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words that may stand in a row: each place where two meet is such a cut.
JOINS = re.compile(r" \S(?:.*\S)?", re.DOTALL)
SPACE = 0x20
LOW = 0xFFFFFFFF
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def _byte_level_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level token: printable Latin-1 letters are themselves, all other bytes take
    the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [byte for byte in range(256) if byte not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(other)}}


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ...``, ``size[i]`` numbers for every i."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what a task remembers of words and windows."""

    def __init__(self, byte_level: bytes, pieces: bytes, remembered: int = REMEMBERED):
        import sentencepiece
        import tokenizers
        # a task has one core; the library would start a thread for each core of the machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = _byte_level_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = (bytes(letters[x] for x in token) if all(x in letters for x in token)
                               else token.encode())
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b.vocab_size())]
        # merges never cross a cut if no piece has a space after another letter
        self.apart = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.a_len, self.a_space = self._shape(self.a_bytes)
        self.b_len, self.b_space = self._shape(self.b_bytes)
        self.remembered = remembered
        self.words, self.sides, self.fine = {}, ([], []), []
        self.forget()
        self.windows = Windows(self)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @staticmethod
    def _shape(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return (np.array([len(x) for x in tokens], np.int64), np.array([x[:1] == b" " for x in tokens]))

    def covers(self, a: list[int], b: list[int], text: str) -> bool:
        """Whether the bytes of both runs of tokens are those of the text."""
        want = text.encode()
        return (b"".join(map(self.a_bytes.__getitem__, a)) == want
                and b"".join(map(self.b_bytes.__getitem__, b)) == want)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Which texts have tokens, and for A and for B: their ids one after another, and how many each of them has.

        A encodes a space and the text, B the text. Both are put together from words, each encoded once: neither joins
        letters across a single space between two words. A text whose tokens' bytes are not space and text has no tokens.
        """
        cut = [(CUT.split(" " + text) if self.apart else [" " + text]) if text else [] for text in texts]
        parts = list(chain.from_iterable(cut))
        self._look_up(list(dict.fromkeys(parts)))
        codes = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        used, place = np.unique(codes, return_inverse=True)
        sides = [self._rows(side, used.tolist()) for side in self.sides]
        there = np.array([bool(x) for x in texts])
        for i in np.unique(owner[~np.array(self.fine)[codes]]).tolist() if len(codes) else []:
            mine = codes[owner == i].tolist()
            a, b = (self._rows(side, mine)[0] for side in self.sides)
            there[i] = self.covers(a.tolist(), b.tolist(), " " + texts[i])
        place, owner = place[there[owner]], owner[there[owner]]
        out = []
        for flat, size, start in sides:
            counts = np.bincount(owner, size[place], len(texts)).astype(np.int64)
            out.append((flat[_spread(start[place], size[place])], counts[there]))
        for word in self.long:
            code = self.words.pop(word)
            self.sides[0][code] = self.sides[1][code] = b""
        self.long = []
        return there, *out

    def forget(self) -> None:
        """Begin anew, with the words so far in reach: one that is met again comes along, others go the next time."""
        self.old = (self.words, self.sides, self.fine)
        self.words, self.sides, self.fine, self.long = {}, ([], []), [], []

    def _look_up(self, words: list[str]) -> None:
        """Let ``self.words`` have all the words: from before, or encoded now."""
        if len(self.words) > self.remembered:
            self.forget()
        missing = [word for word in words if word not in self.words]
        known, sides, fine = self.old
        again = [word for word in missing if word in known]
        codes = list(map(known.__getitem__, again))
        self._add(again, *(map(side.__getitem__, codes) for side in sides), map(fine.__getitem__, codes))
        new = [word for word in missing if word not in known]
        joins = [self.apart and JOINS.fullmatch(word) is not None for word in new]
        for alike, run in ((True, list(compress(new, joins))), (False, [w for w, x in zip(new, joins) if not x])):
            for i in range(0, len(run), ENCODED):
                self._encode_words(run[i:i + ENCODED], alike)

    def _encode_words(self, some: list[str], joins: bool) -> None:
        """Remember new words. ``joins``: A may encode them as one text."""
        sizes = np.array([len(word.encode()) for word in some])
        all_a, ends_a = self._joined(some, sizes) if joins else (None, None)
        if all_a is None:
            a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
            all_a, ends_a = list(chain.from_iterable(a)), np.cumsum([len(x) for x in a])
        b = self.b.encode([word[1:] for word in some], num_threads=1)
        all_b, ends_b = list(chain.from_iterable(b)), np.cumsum([len(x) for x in b])
        bytes_a, bytes_b = self._bytes(self.a_len, all_a, ends_a), self._bytes(self.b_len, all_b, ends_b)
        if self.covers(all_a, all_b, "".join(some)):
            fine = ((bytes_a == sizes) & (bytes_b == sizes)).tolist()
        else:
            ends = ends_a.tolist()
            fine = map(self.covers, (all_a[s:e] for s, e in zip([0, *ends], ends)), b, some)
        self._add(some, self._packed(all_a, ends_a), self._packed(all_b, ends_b), fine)
        self.long.extend(word for word in some if len(word) > LONGEST_KEPT)

    def _joined(self, some: list[str], sizes: np.ndarray) -> tuple[list[int] | None, np.ndarray | None]:
        """A's ids of the words in a row, and where each word's end; nothing if a token's bytes would reach across."""
        ids = self.a.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
        reach, want = np.cumsum(self.a_len[np.array(ids, np.int64)]), np.cumsum(sizes)
        at = np.searchsorted(reach, want)
        if len(reach) == 0 or reach[-1] != want[-1] or (reach[at] != want).any():
            return None, None
        return ids, at + 1

    def _add(self, words: list[str], a, b, fine) -> None:
        first = len(self.fine)
        self.words.update(zip(words, range(first, first + len(words))))
        self.sides[0].extend(a)
        self.sides[1].extend(b)
        self.fine.extend(fine)

    @staticmethod
    def _packed(ids: list[int], ends: np.ndarray) -> list[bytes]:
        """The ids of each word as bytes of 32-bit numbers: a fraction of what lists take."""
        raw, ends = np.array(ids, np.int32).tobytes(), (ends * 4).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]

    @staticmethod
    def _bytes(lengths: np.ndarray, ids: list[int], ends: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(lengths[np.array(ids, np.int64)]))[ends], prepend=0)

    @staticmethod
    def _rows(side: list[bytes], used: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = list(map(side.__getitem__, used))
        size = np.array([len(x) for x in rows], np.int64) // 4
        return np.frombuffer(b"".join(rows), np.int32).astype(np.int64), size, np.cumsum(size) - size


class Windows:
    """Alignments of distinct windows, remembered by their two tuples of ids."""

    def __init__(self, tool: Tokenizers):
        self.a_len, self.b_len = tool.a_len, tool.b_len
        most = max(len(self.a_len), len(self.b_len))
        self.written = [f"{i}{mark}" for mark in (",", "|", ";") for i in range(most)]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups = self.links = np.empty(0, np.int64)
        self.ends = np.empty(0, np.int64)

    def learn(self, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> None:
        """Align new windows, whose ids come one after another; both sides of a window cover the same bytes.

        A token of A and one of B that share bytes share one run of bytes, without an end inside: so the links are the
        runs between neighbouring ends of either side, and the groups end where both sides do.
        """
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)]
        links = a[np.searchsorted(ends_a, cuts)] << 32 | b[np.searchsorted(ends_b, cuts)]
        at = np.searchsorted(ends_b, ends_a)
        last_a, last_b = ends_b[at] == ends_a, np.zeros(len(ends_b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # written in the order of groups, A before B; the mark behind an id: "," within, "|" between sides, ";" at the end
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        marks = np.concatenate([last_a * 1, last_b * 2])
        written = list(map(self.written.__getitem__, (np.concatenate([a, b]) + marks * self.most)[order].tolist()))
        over = ends_a[np.cumsum(sizes_a) - 1]
        link_ends, group_ends = np.searchsorted(cuts, over) + 1, np.cumsum(last_a)[np.cumsum(sizes_a) - 1]
        text_ends = np.cumsum(sizes_a + sizes_b).tolist()
        self.ends = np.append(self.ends, link_ends + len(self.links))
        self.links = np.append(self.links, links)
        self.groups = np.append(self.groups, np.diff(group_ends, prepend=0))
        self.texts.extend("".join(written[s:e]) for s, e in zip([0, *text_ends], text_ends))


def _keys(ids_a: np.ndarray, sizes_a: np.ndarray, ids_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows' two tuples of ids as numbers one after another (ids of A, a mark, ids of B), and where each ends."""
    ends = np.cumsum(sizes_a + 1 + sizes_b)
    keys = np.full(int(ends[-1]), -1, np.int32)
    keys[_spread(ends - sizes_a - 1 - sizes_b, sizes_a)] = ids_a
    keys[_spread(ends - sizes_b, sizes_b)] = ids_b
    return keys, ends


def _distinct(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first of every distinct run of numbers, and for each run which of them it equals.

    By a hash, which is held against the numbers themselves; should two runs share a hash, all count as distinct.
    """
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    inside = np.arange(len(keys)) - np.repeat(starts, sizes)
    hashes = np.add.reduceat((keys + 2).astype(np.uint64) * _WEIGHTS[inside & (len(_WEIGHTS) - 1)], starts)
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    own = first[place]
    if (sizes[own] != sizes).any() or (keys[_spread(starts[own], sizes)] != keys).any():
        return np.arange(len(ends)), np.arange(len(ends))
    order = np.argsort(first, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return first[order], back[place]


def align_block(tool: Tokenizers, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
                ) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows of several documents, and where each document's begin (one more than documents)."""
    (ids_a, counts_a), (ids_b, _) = a, b
    if len(ids_a) == 0:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    ends_a, ends_b, first_a = np.cumsum(tool.a_len[ids_a]), np.cumsum(tool.b_len[ids_b]), np.cumsum(counts_a)
    # tokens of A whose end is also an end of B, then those before a space-marked token of both, or at a document's end
    at = np.searchsorted(ends_b, ends_a)
    shared = ends_b[at] == ends_a
    opens_a, opens_b = np.append(tool.a_space[ids_a[1:]], True), np.append(tool.b_space[ids_b[1:]], True)
    anchor = shared & opens_a & opens_b[at]
    anchor[first_a - 1] = True
    cut_a = np.flatnonzero(anchor) + 1
    cut_b = at[cut_a - 1] + 1
    begin_a, begin_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    sizes_a, sizes_b = cut_a - begin_a, cut_b - begin_b
    first, place = _distinct(*_keys(ids_a, sizes_a, ids_b, sizes_b))
    known, codes = tool.windows.codes, []
    before = len(known)
    some_a, some_b = sizes_a[first], sizes_b[first]
    picked_a, picked_b = ids_a[_spread(begin_a[first], some_a)], ids_b[_spread(begin_b[first], some_b)]
    keys, ends = _keys(picked_a, some_a, picked_b, some_b)
    raw, s = keys.tobytes(), 0
    for e in (ends * 4).tolist():
        codes.append(known.setdefault(raw[s:e], len(known)))
        s = e
    codes = np.array(codes, np.int64)
    new = codes >= before
    if new.any():
        tool.windows.learn(picked_a[np.repeat(new, some_a)], some_a[new],
                           picked_b[np.repeat(new, some_b)], some_b[new])
    codes = codes[place]
    return codes, np.append(0, np.searchsorted(cut_a, first_a, "right"))


def _narrow(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as many bytes each as the largest one needs; the first byte says how many."""
    largest = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if largest < 1 << (8 * w))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _wide(content: bytes) -> np.ndarray:
    """What :func:`_narrow` has packed."""
    return np.frombuffer(content, f"<u{content[0]}", offset=1).astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizers(byte_level: bytes, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


_STATISTICS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("pairs", T.BinaryType()), T.StructField("pair_counts", T.BinaryType()),
    T.StructField("window_links", T.BinaryType()), T.StructField("window_sizes", T.BinaryType()),
    T.StructField("codes", T.BinaryType()), T.StructField("document_sizes", T.BinaryType()),
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
        T.StructField("groups_sha256", T.StringType())])))])


def _pack(tool: Tokenizers, ids: list, texts: list[str | None]) -> dict:
    """One block: its distinct pairs and windows, its documents as runs of windows, and what is known of each document."""
    windows = tool.windows
    if len(windows.links) > 4 * tool.remembered:
        windows.clear()
    there, a, b = tool.encode([x or "" for x in texts])
    codes, bounds = align_block(tool, a, b)
    used, codes = np.unique(codes, return_inverse=True)
    sizes = np.diff(windows.ends, prepend=0)[used]
    pairs, place = np.unique(windows.links[_spread(windows.ends[used] - sizes, sizes)], return_inverse=True)
    times = np.bincount(codes, minlength=len(used))
    counts = np.bincount(place, np.repeat(times, sizes), len(pairs)).astype(np.int64)
    groups = windows.groups[used]
    strings = [windows.texts[i] for i in used.tolist()]
    documents, ends, k = [], [], 0
    for key, fine in zip(ids, there):
        if fine:
            own = codes[bounds[k]:bounds[k + 1]]
            sha = hashlib.sha256("".join(map(strings.__getitem__, own.tolist()))[:-1].encode()).hexdigest()
            documents.append((key, int(a[1][k]), int(b[1][k]), int(groups[own].sum()), int(sizes[own].sum()), sha))
            k += 1
        else:
            documents.append((key, 0, 0, 0, 0, ""))
        ends.append(int(bounds[k]))
    return {"pairs": pairs.tobytes(), "pair_counts": _narrow(counts), "window_links": _narrow(place),
            "window_sizes": _narrow(sizes), "codes": _narrow(codes), "document_sizes": _narrow(np.diff(ends, prepend=0)),
            "documents": [dict(zip(_STATISTICS, x)) for x in documents]}


def blocks(docs: DataFrame, byte_level_path: str, pieces_path: str, key: str = "doc_id", text: str = "text",
           block: int = BLOCK) -> DataFrame:
    """Aligned documents in blocks, in the shared folder: every text is encoded once, whatever is asked of it later.

    One row per block: ``block, pairs, pair_counts, window_links, window_sizes, codes, document_sizes, documents``. The
    binary columns are numpy arrays, all but ``pairs`` in as few bytes as their numbers need: the block's distinct pairs (A's id in the upper 32 bits) and their links; per window its links
    as places in ``pairs``; per document its windows. A text that is null, empty, or whose tokens' bytes are not space and
    text has no windows. Rows of equal key or text stay rows of their own; an empty table has no blocks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    first, second = send_file(spark, byte_level_path), send_file(spark, pieces_path)
    arrow = [("block", pa.int64())] + [(f.name, pa.large_binary()) for f in _BLOCK.fields[1:-1]]
    documents = pa.list_(pa.struct([(x, pa.string() if x == "groups_sha256" else pa.int64()) for x in _STATISTICS]))

    def gather(batches):
        tool, number = _tokenizers(first.value, second.value), TaskContext.get().partitionId() << 32

        def row(ids, texts):
            made = {"block": number, **_pack(tool, ids, texts)}
            return pa.RecordBatch.from_arrays(
                [*(pa.array([made[name]], kind if kind == pa.int64() else pa.binary()) for name, kind in arrow),
                 pa.array([made["documents"]], documents)], [f.name for f in _BLOCK.fields])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.as_py()
                if texts and size + len(x or "") > block:
                    yield row(ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(x)
                size += len(x or "") + 64
        if texts:
            yield row(ids, texts)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return settle(rows.mapInArrow(gather, _BLOCK), "token-alignment")


def _pairs(made: DataFrame) -> DataFrame:
    """``block, at, pair, n``: every block's distinct pairs."""
    def unfold(batches):
        for batch in batches:
            for number, pairs, counts in zip(*(batch.column(i) for i in range(3))):
                pairs, counts = np.frombuffer(pairs.as_py(), np.int64), _wide(counts.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), number.as_py(), np.int64)),
                     pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(counts)],
                    ["block", "at", "pair", "n"])

    return made.select("block", "pairs", "pair_counts").mapInArrow(unfold, "block bigint, at int, pair bigint, n bigint")


def a_id(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def b_id(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(LOW))


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair, links, best``: links of every pair of ids in the corpus, and whether none of the same B id has more.

    The last step's groups are the pairs of one B id, at most as many as A has tokens.
    """
    totals = _pairs(made).groupBy("pair").agg(F.sum("n").alias("links"))
    most = F.max("links").over(Window.partitionBy(b_id(F.col("pair"))))
    return totals.select("pair", "links", (F.col("links") == most).alias("best"))


def document_links(made: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document of the blocks."""
    answers = (_pairs(made).join(counts, "pair").groupBy("block")
               .agg(F.array_sort(F.collect_list(F.struct("at", "links", "best"))).alias("answers"))
               .select("block", F.col("answers.links").alias("links"), F.col("answers.best").alias("best")))
    asked = made.select("block", "window_links", "window_sizes", "codes", "document_sizes", "documents").join(
        answers, "block", "left")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                links, sizes, codes, counts = (_wide(batch.column(j)[i].as_py()) for j in range(1, 5))
                window_ends, document_ends = np.cumsum(sizes), np.cumsum(counts)
                documents = batch.column(5)[i].values
                totals = []
                for j in (7, 6):
                    answer = batch.column(j)[i]
                    values = (answer.values.cast(pa.int64()).to_numpy(zero_copy_only=False) if answer.is_valid
                              else np.empty(0, np.int64))
                    window = np.diff(np.append(0, np.cumsum(values[links])[window_ends - 1])) if len(links) else values
                    running = np.append(0, np.cumsum(window[codes]))
                    totals.append(pa.array(np.diff(running[document_ends], prepend=0)))
                kept = [documents.field(name) for name in _STATISTICS]
                yield pa.RecordBatch.from_arrays([*kept[:5], *totals, kept[5]], names)

    return asked.mapInArrow(add_up, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                    "n_best bigint, count_sum bigint, groups_sha256 string")


def digest(docs: DataFrame, byte_level_path: str, pieces_path: str) -> DataFrame:
    """The contract's row for every document."""
    made = blocks(docs, byte_level_path, pieces_path)
    return document_links(made, pair_counts(made))
