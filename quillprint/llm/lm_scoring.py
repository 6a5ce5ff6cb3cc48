"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt into blocks. A block asks once for each of its distinct n-grams, with its own count; the requests of
all blocks meet in tables partitioned by the n-gram's hash, where counts are added up, and the totals go back to the
blocks that asked. So a word that every document holds costs one row per block, and nothing is gathered elsewhere. The
block then scores its documents. What goes through the disk is coded: texts as compressed Arrow, the sorted hashes of a
request by their gaps, answers as what other blocks have counted.

    S(w | history) = count(history w) / count(history)   if count(history w) >= min_count
                   = backoff * S(w | shorter history)    otherwise; count(w) / words of the corpus at the end.

An n-gram's own document is not taken out of the counts; ``min_count`` keeps what was met once only from speaking for
itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm import grams
from quillprint.session import ship_package

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
#: Characters of a block of documents, and of the text whose n-grams one partition of the tables counts. A document is
#: never cut.
BLOCK_CHARS = 12_000_000
TABLE_CHARS = 6_000_000
#: Characters of text that a task deals out to blocks at once.
DEALT_CHARS = 32_000_000
#: Stands for the empty n-gram, whose count is the number of words.
EMPTY = np.uint64(0x9E3779B97F4A7C15)


def _runs(texts, order: int) -> tuple[list[np.ndarray], list[list[int]]]:
    """Hashes of the n-grams of all texts, one array per text and length, and how many words each text has."""
    found, sizes = [], []
    for first, last, data, offsets in grams.pieces(texts):
        hashes, bounds = grams.words(data, offsets, grams.SPACES)
        runs = [grams.ngrams(hashes, n) for n in range(1, order + 1)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            sizes.append(int(high - low))
            found.extend(run[low:max(low, high - n)] for n, run in enumerate(runs))
    return found, sizes


def _ends(asked: np.ndarray, tables: int) -> np.ndarray:
    """Where the table partitions begin in sorted n-grams: each has a range of the hashes."""
    place = ((asked >> np.uint64(32)) * np.uint64(tables)) >> np.uint64(32)
    return np.searchsorted(place, np.arange(tables + 1, dtype=np.uint64))


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte by byte: all the lowest bytes, then the next ones."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(content: bytes) -> np.ndarray:
    """What :func:`_packed` has made."""
    size = int.from_bytes(content[:8], "little")
    planes = np.frombuffer(pa.decompress(content[8:], 8 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<u8").ravel()


def _packed_gaps(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=np.uint64(0)))


def _unpacked_gaps(content: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(content), dtype=np.uint64)


def _packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked_rows(block: pa.Table) -> pa.Table:
    """The documents of a block, from as many pieces as it came in."""
    return pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in block.column("rows"))


def _log_score(counts: list[np.ndarray], words: float, backoff: float, min_count: int) -> float:
    """Sum of ln S of one text from the counts of its n-grams by length."""
    logs = [np.log(c) for c in counts]
    value = logs[0] - np.log(words)
    for n in range(1, len(counts)):
        if not len(counts[n]):
            break
        seen = logs[n] - logs[n - 1][:len(logs[n])]
        value[n:] = np.where(counts[n] >= min_count, seen, np.log(backoff) + value[n:])
    return float(value.sum())


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT,
          key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS,
          table_chars: int = TABLE_CHARS) -> DataFrame:
    """``key, n_words, log_score, mean_log_score`` of every document: the sum of ln S over its words, and by word.

    Words are what ASCII white space separates, A-Z lower-cased. A document without words, or null, has 0 words, the sum
    0 and no mean. Rows stay one to one; repeated rows count as often as they stand. Blocks follow from key and text, so
    that a task that runs again asks the same.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.length(F.col(text)).cast("bigint"))).first()[0] or 0
    blocks, tables = max(1, -(-size // block_chars)), max(1, -(-size // table_chars))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).alias("block"))

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > DEALT_CHARS:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def dealt(held):
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        names, starts = np.unique(block[order], return_index=True)
        pieces = [_packed_rows(table.select(["key", "text"]).take(pa.array(own)))
                  for own in np.split(order, starts[1:])] if len(names) else []
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(pieces, pa.binary())], ["block", "rows"])

    def ask(block: pa.Table) -> pa.Table:
        found, sizes = _runs(_unpacked_rows(block).column("text"), order)
        every = np.concatenate(found)
        del found
        asked, counts = np.unique(every, return_counts=True)
        at = np.searchsorted(asked, EMPTY)
        asked, counts = np.insert(asked, at, EMPTY), np.insert(counts, at, sum(sizes))
        ends = _ends(asked, tables)
        used = np.flatnonzero(np.diff(ends))
        spans = [slice(ends[i], ends[i + 1]) for i in used]
        return pa.table({"block": pa.array(np.full(len(used), block.column("block")[0].as_py(), np.int64)),
                         "part": pa.array(used, pa.int64()),
                         "grams": pa.array([_packed_gaps(asked[own]) for own in spans], pa.binary()),
                         "counts": pa.array([_packed(counts[own]) for own in spans], pa.binary())})

    def add_up(asked: pa.Table) -> pa.Table:
        lists = [_unpacked_gaps(x.as_py()) for x in asked.column("grams")]
        own = np.concatenate([_unpacked(x.as_py()) for x in asked.column("counts")]).astype(np.int64)
        _, where = np.unique(np.concatenate(lists), return_inverse=True)
        others = np.bincount(where, own).astype(np.int64)[where] - own
        others = np.split(others, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"block": asked.column("block").combine_chunks(), "part": asked.column("part").combine_chunks(),
                         "others": pa.array(map(_packed, others), pa.binary())})

    def answer(block: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unpacked_rows(block)
        found, sizes = _runs(docs.column("text"), order)
        lengths, every = [len(x) for x in found], np.concatenate(found)
        del found
        by = np.argsort(every)
        every = every[by]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        starts = np.flatnonzero(new)
        times, at = np.diff(starts, append=len(every)), np.searchsorted(every[starts], EMPTY)
        own = np.insert(times, at, sum(sizes))
        del every, new, starts
        lists = answers.column("others").take(pa.array(np.argsort(answers.column("part").to_numpy())))
        totals = (own + np.concatenate([_unpacked(x.as_py()).astype(np.int64) for x in lists])).astype(np.float64)
        words, totals = totals[at], np.delete(totals, at)
        counts = np.empty(len(by))
        counts[by] = np.repeat(totals, times)
        del by
        counts = np.split(counts, np.cumsum(lengths)[:-1])
        logs = [_log_score(counts[i * order:(i + 1) * order], words, backoff, min_count) if n else 0.0
                for i, n in enumerate(sizes)]
        return pa.table({"key": docs.column("key").combine_chunks(), "n_words": pa.array(sizes, pa.int64()),
                         "log_score": pa.array(logs, pa.float64())})

    kind = rows.schema["key"].dataType.simpleString()
    packed = rows.mapInArrow(deal, "block bigint, rows binary")
    requests = packed.groupBy("block").applyInArrow(ask, "block bigint, part bigint, grams binary, counts binary")
    answers = requests.groupBy("part").applyInArrow(add_up, "block bigint, part bigint, others binary")
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        answer, f"key {kind}, n_words bigint, log_score double")
    return scored.select(F.col("key").alias(key), "n_words", "log_score",
                         F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def digest(docs: DataFrame) -> DataFrame:
    """Scores of order 2 with four and six digits. Tables are of twice the text, as a text has fewer n-grams."""
    return _rounded(score(docs, 2, table_chars=2 * TABLE_CHARS))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", (F.round("log_score", 4) + F.lit(0.0)).alias("log_score"),
                         (F.round("mean_log_score", 6) + F.lit(0.0)).alias("mean_log_score"))


def trigram_digest(docs: DataFrame) -> DataFrame:
    """Scores of order 3, the operator's own."""
    return _rounded(score(docs))


def digest_sql(backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> str:
    """Order 2 from the table ``documents``."""
    return rf"""
    WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
    placed AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
               FROM split, unnest(range(1, len(w) + 1)) t(i)),
    singles AS (SELECT b AS word, count(*) AS n FROM placed GROUP BY 1),
    pairs AS (SELECT a, b, count(*) AS n FROM placed WHERE a IS NOT NULL GROUP BY 1, 2),
    scored AS (SELECT doc_id, i, CASE
            WHEN p.a IS NULL THEN ln(sb.n) - ln((SELECT sum(n) FROM singles))
            WHEN ab.n >= {min_count} THEN ln(ab.n) - ln(sa.n)
            ELSE ln({backoff}::DOUBLE) + (ln(sb.n) - ln((SELECT sum(n) FROM singles))) END AS s
        FROM placed p JOIN singles sb ON sb.word = p.b LEFT JOIN pairs ab ON ab.a = p.a AND ab.b = p.b
        LEFT JOIN singles sa ON sa.word = p.a),
    summed AS (SELECT doc_id, sum(s) AS total FROM scored GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, round(coalesce(total, 0), 4) + 0.0 AS log_score,
           round(total / nullif(len(w), 0), 6) + 0.0 AS mean_log_score
    FROM split LEFT JOIN summed USING (doc_id)"""


def trigram_digest_sql(backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> str:
    """Order 3 from the table ``documents``."""
    return f"""
    WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
    placed AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
               FROM split, unnest(range(1, len(w) + 1)) t(i)),
    singles AS (SELECT c AS word, count(*) AS n FROM placed GROUP BY 1),
    pairs AS (SELECT b, c, count(*) AS n FROM placed WHERE b IS NOT NULL GROUP BY 1, 2),
    triples AS (SELECT a, b, c, count(*) AS n FROM placed WHERE a IS NOT NULL GROUP BY 1, 2, 3),
    first AS (SELECT p.*, ln(sc.n) - ln((SELECT sum(n) FROM singles)) AS s1, sb.n AS n_b, bc.n AS n_bc
        FROM placed p JOIN singles sc ON sc.word = p.c LEFT JOIN singles sb ON sb.word = p.b
        LEFT JOIN pairs bc ON bc.b = p.b AND bc.c = p.c),
    second AS (SELECT *, CASE WHEN b IS NULL THEN s1 WHEN n_bc >= {min_count} THEN ln(n_bc) - ln(n_b)
            ELSE ln({backoff}::DOUBLE) + s1 END AS s2 FROM first),
    scored AS (SELECT p.doc_id, CASE WHEN p.a IS NULL THEN s2 WHEN abc.n >= {min_count} THEN ln(abc.n) - ln(ab.n)
            ELSE ln({backoff}::DOUBLE) + s2 END AS s
        FROM second p LEFT JOIN pairs ab ON ab.b = p.a AND ab.c = p.b
        LEFT JOIN triples abc ON abc.a = p.a AND abc.b = p.b AND abc.c = p.c),
    summed AS (SELECT doc_id, sum(s) AS total FROM scored GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, round(coalesce(total, 0), 4) + 0.0 AS log_score,
           round(total / nullif(len(w), 0), 6) + 0.0 AS mean_log_score
    FROM split LEFT JOIN summed USING (doc_id)"""
