"""Secret scans: fixed patterns, and a guess-cost model for what stands in credential contexts.

The guess cost of a value is the smallest sum, over all ways to cut it into segments, of the logarithms of how many tries
a segment takes: fixed words and the corpus's by rank, dates, repeats, runs along keyboard rows, alphabet and digits, and brute force by
character class. A value in a credential context that takes many tries is marked even where no fixed pattern matches.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.session import discard, settle, ship_package

# The patterns of the three kinds and the shortest match that counts.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a whole run, as runs are taken whole
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Names whose value is rated, also within an identifier. "pin" begins a word or a part of one, as it ends many others.
NAME = re.compile(r"(?ai:pass(?:word|wd|phrase|code)|pwd|credentials?|secret|token|(?:api|access|private)[_-]?key"
                  r"|(?<![a-z])pin|(?-i:(?<=[a-z])Pin))")
#: The rest of a name, of any length.
TAIL = re.compile(r"(?ai:(?:key|id|value)?(?:[_.-][a-z0-9_.-]*+)?)")
#: A separator or "is", and a value: up to its closing quote on the line, or without white space, or an element's content.
VALUE = re.compile(r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([^\s"'<>,;]{6,}))"""
                   r"""|["']?[\x20\t]+is[\x20\t]+["']?([^\s"'<>,;]{6,})|>([^\s<>]{6,})</""")
#: Values that need no name: a password in an address, and a bearer token that holds a digit.
ADDRESS = re.compile(r"""://[^\s/:@"'<>]*+:([^\s/@"'<>]{6,})@""")
BEARER = re.compile(r"(?ai:(?<![a-z])bearer)[\x20\t]+(?=[A-Za-z._~+/=-]*+[0-9])([A-Za-z0-9._~+/=-]{6,})")
#: Tries, as a power of ten, from which a value counts as a secret rather than a word or a placeholder.
MIN_TRIES = 8.0
#: A repeat or walk may be cut anywhere within so many characters; beyond, it goes on to the end of its run.
SEGMENT = 24
#: The words ranked stand in at least WORD_DOCS documents, have at most WORD_LETTERS letters, and are the most frequent
#: ones, down to a frequency that at most WORDS_KEPT of them reach.
WORDS_KEPT = 100_000
WORD_DOCS = 3
WORD_LETTERS = 64
#: What stands in the place of a value, in the form of the JVM: no words are taken from it.
ASSIGNED = r"""[:=]>?[ \t]*+(?:"[^"\r\n]*+"|'[^'\r\n]*+'|["']?[^\s"'<>,;]++)"""
TOLD = (r"""(?i)(?:pass(?:word|wd|phrase|code)|pwd|credentials?|secret|token|[_-]?key|pin)(?:[_-]?(?:key|id|value))?"""
        r"""["']?[ \t]++is[ \t]++["']?[^\s"'<>,;]++""")

# Words by how soon they are tried.
WORDS = """password admin welcome letmein monkey dragon master login secret test user root guest changeme example
sample default hello iloveyou sunshine princess football baseball shadow superman batman trustno access pass token key
demo temp null none true false your my the value string here insert enter placeholder xxx foo bar baz qux database
server system service account private public love summer winter spring autumn january february march april may june
july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()


class Ranks(dict):
    """Ranks of words, and how long the longest is."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__(ranks)
        self.longest = max(map(len, ranks), default=0)

    def __reduce__(self):
        return Ranks, (dict(self),)


RANK = Ranks({w: i + 1 for i, w in enumerate(WORDS)})
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {pair for row in ROWS for line in (row, row[::-1]) for pair in zip(line, line[1:])}
DATE = re.compile(r"(?:(?:19|20)\d\d)(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)


def _class_size(c: str) -> int:
    if c.isascii():
        if c.isdigit():
            return 10
        return 26 if c.isalpha() else 33
    return 1000


class Runs:
    """Where the run through a position ends: of characters equal to the one 1, 2, 3 or 4 before, and of a walk."""

    def __init__(self, value: str):
        self.value = value
        self.known = [(1, 0)] * 5

    def _goes(self, run: int, i: int) -> bool:
        if run == 4:
            return (self.value[i - 1].lower(), self.value[i].lower()) in _NEXT
        return self.value[i] == self.value[i - run - 1]

    def end(self, run: int, start: int) -> int:
        """The first position from ``start`` on that does not go on; every run is walked once."""
        first, last = self.known[run]
        if not first <= start <= last:
            last = start
            while last < len(self.value) and self._goes(run, last):
                last += 1
            self.known[run] = (start, last)
        return last


def _segments(value: str, start: int, ranks: Ranks = RANK, runs: Runs | None = None):
    """``end, tries as a power of ten`` of every segment of a pattern that starts here."""
    runs = runs or Runs(value)

    def cuts(end):
        yield from range(start + 3, min(end, start + SEGMENT) + 1)
        if end > start + SEGMENT:
            yield end

    def after(run, ahead):
        return runs.end(run, start + ahead) if start + ahead < len(value) else len(value)

    stop = min(len(value), start + ranks.longest)
    low = value[start:stop].lower()
    plain = low.translate(LEET)
    for end in range(start + 3, stop + 1):
        word = low[:end - start]
        rank, extra = ranks.get(word), 0.0
        if rank is None:
            rank, extra = ranks.get(plain[:end - start]), 1.0
        if rank is not None:
            turned = sum(c.isupper() for c in value[start:end])
            yield end, math.log10(rank) + extra + (math.log10(2) * min(turned, 3) if turned else 0.0)
    for last in cuts(after(0, 1)):
        yield last, math.log10(_class_size(value[start]) * (last - start))
    for period in (2, 3, 4):  # repeats of a short block
        end = after(period - 1, period)
        if end >= start + 2 * period:
            yield end, sum(math.log10(_class_size(c)) for c in value[start:start + period]) + math.log10(end - start)
    for last in cuts(after(4, 1)):
        yield last, math.log10(47 * (last - start))
    date = DATE.match(value, start)
    if date:
        yield date.end(), math.log10(365 * 120) if date.end() - start > 4 else math.log10(120)


def tries(value: str, ranks: Ranks = RANK, enough: float = math.inf) -> float:
    """Logarithm to base 10 of the guesses that the cheapest segmentation takes; 0 for the empty value. Where every way on
    already takes ``enough`` or more, the answer is ``enough``, whatever is left of the value."""
    best = [0.0] + [math.inf] * len(value)
    runs = Runs(value)
    reach = 0  # the furthest position that takes less than enough
    for start in range(len(value)):
        if start > reach:
            return enough
        if best[start] >= enough:
            continue
        brute = best[start] + math.log10(_class_size(value[start]))
        for end, cost in ((start + 1, brute - best[start]), *_segments(value, start, ranks, runs)):
            cost += best[start]
            if cost < best[end]:
                best[end] = cost
                if cost < enough:
                    reach = max(reach, end)
    return min(best[-1], enough)


def corpus_ranks(docs: DataFrame, text: str = "text", least: int = WORD_DOCS) -> Ranks:
    """The fixed words, and the corpus's words by the number of documents that hold them; the better rank counts.

    A word is a run of three letters or more. What follows a colon, an equals sign or a credential's "is" gives no words, so a
    secret does not make itself known in however many documents it is assigned. The table has at most WORDS_KEPT words
    of WORD_LETTERS letters, whatever the corpus: a histogram of frequencies tells from which one on they fit.
    """
    prose = F.regexp_replace(F.regexp_replace(F.col(text), ASSIGNED, " "), TOLD, " ")
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(prose), F.lit(r"\p{L}{3,}"), F.lit(0))))
                       .alias("word"))
    counts = held.where(F.length("word") <= WORD_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts.where(F.col("n") >= least), "words")
    level = F.floor(F.log2("n") * 16)  # at most 1 024 levels
    room, lowest = WORDS_KEPT, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if row["count"] > room:
            break
        room, lowest = room - row["count"], row["level"]
    top = [] if lowest is None else counts.where(level >= lowest).collect()
    discard(counts)
    ranks = {r["word"]: i + 1 for i, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["word"])))}
    return Ranks({**ranks, **{w: min(i, ranks.get(w, i)) for w, i in RANK.items()}})


def contexts(text: str):
    """``start, end`` of every value in a credential context. A name is looked at once, however many credential words it
    is made of."""
    done = 0
    for name in NAME.finditer(text):
        if name.start() < done:
            continue
        done = TAIL.match(text, name.end()).end()
        found = VALUE.match(text, done)
        if found and not (found[5] and text[name.start() - 1:name.start()] == "/"):
            done = found.end(found.lastindex)
            yield found.span(found.lastindex)
    if "://" in text:
        yield from (m.span(1) for m in ADDRESS.finditer(text))
    yield from (m.span(1) for m in BEARER.finditer(text))


def spans_of(text: str, ranks: Ranks = RANK) -> list[tuple[int, int, str]]:
    """``start, end, kind`` by start, then kind as listed. Positions count code points."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found += [(a, b, 3) for a, b in set(contexts(text)) if tries(text[a:b], ranks, MIN_TRIES) >= MIN_TRIES]
    return [(start, end, KINDS[kind]) for start, end, kind in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``secrets``: array of ``kind, start, end``; an input column of that name goes.

    A null text is an empty one. Whole texts are searched; an overlap of kinds is reported once per kind. Words are ranked
    by a first pass over all texts.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("secrets")
    known = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text))
    at = docs.columns.index(text)
    names = [*docs.columns, "secrets"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t or "", known.value)]
                     for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names)

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField("secrets", SPANS)]))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    said = "transform({}, x -> concat_ws(':', x.kind, x.start, x.end))"
    base = F.expr(f"array_join({said.format("filter(secrets, x -> x.kind <> 'guess')")}, ',')")
    counts = [F.expr(f"CAST(size(filter(secrets, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join({said.format('secrets')}, ',')").alias("spans"))
