"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is built. A text is cut greedily into the
longest phrases that occur in a language's sample; the language that needs the fewest phrases, normalised by the sample's
length, wins. Every letter of a sample counts as itself, whatever the number of letters; a letter that no sample holds is a
phrase of its own. Many texts walk through the automata in step, so that the cost of a character does not depend on the
interpreter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.session import ship_package

#: The sample of a language: so many different texts, of each a stretch of at most so many characters.
SAMPLE_TEXTS = 150
SAMPLE_CHARS = 240
#: The most frequent letters of all samples have dense columns, so many at most and no more than DENSE_CELLS allow for all
#: automata together; the edges of all other letters are kept as sorted keys. It decides about speed, not results.
ALPHABET = 60
DENSE_CELLS = 1 << 25
#: Texts are parsed in stretches of so many characters; a phrase ends where its stretch does.
STRETCH = 256
SPACE, FOREIGN = 0, 1
UNKNOWN = "und"


def _letters(codepoints: np.ndarray) -> np.ndarray:
    """Lower-cased letters as code points, 0 for everything else."""
    if not len(_FOLDED):
        _FOLDED.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32))
    folded = _FOLDED[0][np.minimum(codepoints, 0xFFFF)]
    high = np.flatnonzero(codepoints > 0xFFFF)
    if len(high):
        folded[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in codepoints[high]]
    return folded


_FOLDED: list[np.ndarray] = []


def _codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _squeezed(codes: np.ndarray, breaks: np.ndarray | None = None) -> np.ndarray:
    """Which characters stay when runs of spaces are one space."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    if breaks is not None:
        keep[breaks[breaks < len(codes)]] = True
    return keep


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``codes``; state 0 is its start."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and c not in edges[state]:
            edges[state][c] = new
            state = link[state]
        if state >= 0:
            target = edges[state][c]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(edges)
                edges.append(dict(edges[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state >= 0 and edges[state].get(c) == target:
                    edges[state][c] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return edges


class Parser:
    """The automata of all languages. The place of a state is that of its row in one table of the frequent letters' edges;
    edges of other letters lie under the key of place and letter. An edge is twice the place it leads to, plus one where
    a new phrase begins."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = {k: _letters(_codepoints("\n".join(samples[k]))) for k in self.languages}
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *joined.values()]), return_counts=True)
        often = values[np.lexsort((values, -counts))]
        often = often[often > 0]
        # code 0 is a space, 1 a letter of no sample, then letters by frequency
        self.letters = np.sort(often)
        self.code_of = np.empty(len(often), np.int64)
        self.code_of[np.searchsorted(self.letters, often)] = np.arange(len(often)) + 2
        self.n_codes = len(often) + 2
        found = []
        for k in self.languages:
            codes = self._codes(joined[k])
            codes = codes[_squeezed(codes)]
            found.append((codes, suffix_automaton(codes.tolist())))
        states = sum(len(edges) for _, edges in found)
        self.width = 2 + max(0, min(ALPHABET, len(often), DENSE_CELLS // max(1, states) - 2))
        tables, keys, goals, self.starts, self.scale, offset = [], [], [], [], [], 0
        for codes, edges in found:
            table = np.full((len(edges), self.width), 2 * offset + 1, np.int64)
            for c, target in edges[0].items():
                goal = 2 * (target * self.width + offset) + 1
                if c < self.width:
                    table[:, c] = goal
                else:
                    keys.append(offset * self.n_codes + c)
                    goals.append(goal)
            for state, out in enumerate(edges[1:], 1):  # whatever leaves the start begins a phrase
                for c, target in out.items():
                    goal = 2 * (target * self.width + offset)
                    if c < self.width:
                        table[state, c] = goal
                    else:
                        keys.append((state * self.width + offset) * self.n_codes + c)
                        goals.append(goal)
            tables.append(table.ravel())
            self.starts.append(offset)
            self.scale.append(math.log2(max(2, len(codes))))
            offset += table.size
        self.table = np.concatenate([np.zeros(0, np.int64), *tables])
        if offset < 2**30:
            self.table = self.table.astype(np.int32)
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys, self.goals = np.array(keys, np.int64)[by_key], np.array(goals, np.int64)[by_key]

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.where(letters > 0, FOREIGN, SPACE)
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, self.code_of[at], np.where(letters > 0, FOREIGN, SPACE))

    def _edges(self, places: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Edges of letters without a dense column: the state's own, else the start's, else back to the start."""
        starts = np.array(self.starts, np.int64)[:, None]
        edge = np.broadcast_to(2 * starts + 1, places.shape).copy()
        for sources in (starts, places.astype(np.int64)):  # the state's own edge comes last and counts
            keys = sources * self.n_codes + codes
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            edge = np.where(self.keys[at] == keys, self.goals[at], edge)
        return edge

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters and characters of every text, and phrases of every text in each language."""
        texts = [t or "" for t in texts]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        letters = _letters(_codepoints("".join(texts)))
        seen = np.concatenate([[0], np.cumsum(letters > 0)])
        n_letters = seen[bounds[1:]] - seen[bounds[:-1]]
        codes = self._codes(letters)
        keep = _squeezed(codes, bounds[:-1])
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, bounds = codes[keep], kept[bounds]
        sizes = np.diff(bounds)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH + bounds[owner]
        left = np.minimum(bounds[owner + 1] - begin, STRETCH)
        phrases = np.zeros((len(self.languages), len(texts)))
        order = np.argsort(-left, kind="stable")  # so that those still under way come first
        owner, begin, left = owner[order], begin[order], left[order]
        rare = codes >= self.width
        some = rare.any()
        dense = np.where(rare, FOREIGN, codes).astype(self.table.dtype)
        for low in range(0, len(owner), 2048):
            part = slice(low, low + 2048)
            at, size = begin[part], left[part]
            states = np.repeat(np.array(self.starts, self.table.dtype)[:, None], len(at), 1)
            found = np.zeros(states.shape, self.table.dtype)
            active = np.searchsorted(-size, -np.arange(size[0]), "left")
            for step, k in enumerate(active):
                here = at[:k] + step
                move = self.table.take(states[:, :k] + dense[here])
                if some:
                    apart = np.flatnonzero(rare[here])
                    move[:, apart] = self._edges(states[:, apart], codes[here[apart]])
                found[:, :k] += move & 1
                states[:, :k] = move >> 1
            for i in range(len(self.languages)):
                phrases[i] += np.bincount(owner[part], found[i], len(texts))
        return n_letters, sizes, phrases


def sample_texts(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS,
                 chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """For each language the stretches of its sample: the ``texts`` different texts of smallest hash."""
    size = F.length(text)
    rows = docs.where(F.col(lang).isNotNull() & (size > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("h"),
        F.substring(F.col(text), F.pmod(F.xxhash64(F.col(text), F.lit(1)), F.greatest(size - chars, F.lit(0)) + 1)
                    .cast("int") + 1, F.lit(chars)).alias("stretch"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.groupBy("lang", "h").agg(F.min("stretch").alias("stretch")).withColumn("place", place).where(
        F.col("place") <= texts).select("lang", "stretch", "h").orderBy("lang", "h").collect()  # bounded by its parameters
    found: dict[str, list[str]] = {}
    for row in chosen:
        found.setdefault(row["lang"], []).append(row["stretch"])
    return {k: v for k, v in found.items() if _letters(_codepoints("".join(v))).any()}


def identify(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``phrase_rate``; input columns of these names go.

    ``lang_pred`` is the language of the fewest normalised phrases, at a tie the first by name; ``und`` for a null, for a
    text without a letter, and where nothing was learned. ``score`` is 1 less the ratio of its phrases to those of the
    next language (1 where only one was learned, 0 for ``und``). ``phrase_rate`` is normalised phrases per character.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("lang_pred", "score", "phrase_rate")
    names = docs.columns
    at = names.index(text)
    parser = spark.sparkContext.broadcast(Parser(samples))

    def judged(texts: list[str | None]):
        model = parser.value
        n_letters, sizes, phrases = model.parse(texts)
        if not model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rates = phrases * np.array(model.scale)[:, None] / np.maximum(sizes, 1)
        best = rates.argmin(axis=0)
        order = np.sort(rates, axis=0)
        score = 1 - order[0] / np.maximum(order[1], 1e-300) if len(rates) > 1 else np.ones(len(texts))
        known = n_letters > 0
        return ([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                np.where(known, np.clip(score, 0, 1), 0.0), np.where(known, order[0], 0.0))

    def label(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size < 1 << 20):
                    size += len(texts[high] or "")
                    high += 1
                for store, values in zip(out, judged(texts[low:high])):
                    store.extend(values)
                low = high
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                 pa.array(out[2], pa.float64())], [*names, "lang_pred", "score", "phrase_rate"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())])
    return docs.mapInArrow(label, schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 on division by 3; a null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the documents that are not held out."""
    samples = sample_texts(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")
