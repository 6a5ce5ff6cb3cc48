"""Benchmark decontamination: a hash set of normalised test n-grams, sent to every task.

Documents are scanned in one pass: words are hashed once, every window of words is looked up in the set, and the words
of a window that is found are compared with the test windows themselves. Only found windows leave the scan. Where the set
is too large to be sent along, window hashes meet it in a shuffled join instead; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.common import UPPER, ascii_lower, text_key
from quillprint.session import settle

WINDOW = 10
#: Up to so many windows (8 bytes each) the set is part of the plan; beyond, it is joined.
SET_WINDOWS = 20_000
#: Bytes of window texts up to which found windows are compared by a broadcast join.
BROADCAST_BYTES = 8 * 1024 * 1024
#: The words of a text that is lower-cased from A-Z to a-z, found before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _starts(n: Column, length: Column) -> Column:
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def windows_of(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """``words, length, hash, items``: every distinct window with the ids of its items as strings.

    An item of fewer words than ``window`` is one window; one without words, or null, has none. A null id is no id.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(
        F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = rows.withColumn("i", F.explode(_starts(F.size("w"), F.col("length"))))
    hashes = [F.when(F.col("length") > j, F.xxhash64(F.lower(F.get("part", F.lit(j))))) for j in range(window)]
    cut = starts.withColumn("part", F.slice("w", F.col("i"), F.col("length"))).select(
        "item", "length", ascii_lower(F.array_join("part", " ")).alias("words"), F.xxhash64(*hashes).alias("hash"))
    return cut.groupBy("words", "length").agg(F.first("hash").alias("hash"), F.collect_set("item").alias("items"))


_HASHES = "transform(words, w -> xxhash64(lower(w)))"


def _window_starts(length: int) -> str:
    """Positions from 0. Windows are read element by element: a slice would walk the whole array each time."""
    return f"IF(size(hs) >= {length}, sequence(0, size(hs) - {length}), CAST(array() AS ARRAY<INT>))"


def _window_hash(length: int) -> str:
    return f"xxhash64({', '.join(f'hs[i + {j}]' for j in range(length))})"


def _scan(text: str, body: str) -> Column:
    """``n`` and ``found`` of a text: its number of words, and ``body`` of ``words`` and their hashes ``hs``."""
    words = f"regexp_extract_all(`{text}`, r'{WORD}', 0)"
    return F.expr(f"""transform(array({words}), words -> named_struct('n', size(words), 'found',
        transform(array({_HASHES}), hs -> {body})[0]))[0]""")


def _cut(start: str, length: str | int) -> str:
    return f"translate(array_join(slice(words, {start}, {length}), ' '), '{UPPER}', '{UPPER.lower()}')"


def _found_by_set(docs: DataFrame, text: str, windows: list) -> DataFrame:
    """``docs`` with ``_scan``: hits of the hash set, verified word by word."""
    parts = ["CAST(array() AS ARRAY<STRUCT<start: INT, length: INT, words: STRING>>)"]
    for length in sorted({w["length"] for w in windows}):
        own = [w for w in windows if w["length"] == length]
        hashes = ", ".join(sorted({f"{w['hash']}L" if w["hash"] > -2**63 else "(-9223372036854775807L - 1L)" for w in own}))
        texts = ", ".join(f"'{w['words']}'" for w in own)  # words hold no quotes and no backslashes
        parts.append(f"""filter(transform(
            filter({_window_starts(length)}, i -> {_window_hash(length)} IN ({hashes})),
            i -> named_struct('start', i + 1, 'length', {length}, 'words', {_cut('i + 1', length)})),
            x -> x.words IN ({texts}))""")
    return docs.withColumn("_scan", _scan(text, f"concat({', '.join(parts)})"))


def _found_by_join(docs: DataFrame, text: str, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same with a shuffled join of window hashes. Findings belong to a text, so equal texts share them."""
    keyed = docs.withColumn("_text_id", text_key(F.col(text)))
    parts = ["CAST(array() AS ARRAY<STRUCT<start: INT, length: INT, hash: BIGINT>>)"] + [
        f"transform({_window_starts(n)}, i -> named_struct('start', i + 1, 'length', {n}, 'hash', {_window_hash(n)}))"
        for n in lengths]
    every = keyed.select("_text_id", F.explode(_scan(text, f"concat({', '.join(parts)})")["found"]).alias("x"))
    hits = every.select("_text_id", "x.*").join(windows.select("length", "hash", "words"), ["length", "hash"])
    starts = hits.groupBy("_text_id").agg(F.collect_set(F.struct("start", "length", "words")).alias("_starts"))
    met = keyed.join(starts, "_text_id", "left").drop("_text_id")
    verified = f"""coalesce(filter(_starts, s -> {_cut('s.start', 's.length')} = s.words), array())"""
    words = f"regexp_extract_all(`{text}`, r'{WORD}', 0)"
    return met.withColumn("_scan", F.expr(
        f"transform(array({words}), words -> named_struct('n', size(words), 'found', {verified}))[0]")).drop("_starts")


def find(docs: DataFrame, windows: DataFrame, text: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``hit_words`` (positions from 1, ascending, of the words inside a test
    window) and ``found`` (``start, length, words`` of each such window).

    ``windows`` comes from :func:`windows_of` and should be a written table. Rows stay one to one, repeated rows too. A
    null text has no words; without windows nothing is hit. Input columns of these names are replaced.
    """
    docs = docs.drop("n_words", "hit_words", "found")
    if windows.count() <= set_windows:
        scanned = _found_by_set(docs, text, windows.select("words", "length", "hash").collect())
    else:
        lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most `window` numbers
        scanned = _found_by_join(docs, text, windows, sorted(lengths))
    positions = F.expr("""array_sort(array_distinct(flatten(transform(
        _scan.found, x -> sequence(x.start, x.start + x.length - 1)))))""")
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns],
                          F.greatest(F.coalesce(F.col("_scan.n"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_words"),
                          F.coalesce(positions, F.array().cast("array<int>")).alias("hit_words"),
                          F.coalesce("_scan.found", F.array()).alias("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW,
                  text: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """The columns of ``docs``: without the documents that hold a test window, or (``action="spans"``) with the words of
    test windows cut out of the texts, each with what stands between it and the next word."""
    if action not in ("documents", "spans"):
        raise ValueError("action is documents or spans")
    windows = settle(windows_of(benchmark, window), "benchmark-windows")
    scanned = find(docs, windows, text, set_windows)
    names = [f"`{c}`" for c in docs.columns]
    if action == "documents":
        return scanned.where(F.size("hit_words") == 0).select(*names)
    words, gaps = f"regexp_extract_all(`{text}`, r'{WORD}', 0)", f"split(`{text}`, r'{WORD}', -1)"
    # Pieces are a word and the gap behind it; the first gap stays.
    rest = F.expr(f"""transform(array(named_struct('w', {words}, 'g', {gaps}, 'h', hit_words)), s -> concat(s.g[0],
        array_join(transform(filter(sequence(1, size(s.w)), i -> NOT array_contains(s.h, i)),
                             i -> concat(s.w[i - 1], s.g[i])), '')))[0]""")
    clean = F.when(F.size("hit_words") > 0, rest).otherwise(F.col(text))
    return scanned.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    windows = settle(windows_of(benchmark, window), "benchmark-windows")
    scanned = find(docs.select("doc_id", "text"), windows, "text", set_windows).select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"),
        F.array_distinct(F.col("found.words")).alias("words"), F.monotonically_increasing_id().alias("row"))
    wanted = windows.select("words", "items")
    if (windows.agg(F.sum(F.length("words") + F.size("items") * 32 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    met = scanned.withColumn("words", F.explode_outer("words")).join(wanted, "words", "left")
    grouped = met.groupBy("row", "doc_id", "n_words", "n_hit").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                          F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                          (F.col("n_hit") > 0).alias("contaminated"))


def digest_sql(window: int = WINDOW) -> str:
    """The same from the tables ``documents`` and ``benchmark``."""
    def words(text):
        low = f"translate({text}, '{UPPER}', '{UPPER.lower()}')"
        return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH items AS (SELECT item_id::VARCHAR AS item, {words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
    sized AS (SELECT item, w, least(len(w), {window}) AS k FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
                FROM sized, unnest(range(1, len(w) - k + 2)) t(i)),
    docs AS (SELECT doc_id, coalesce({words('text')}, []) AS w FROM documents),
    places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM docs, (SELECT DISTINCT k FROM windows) l, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k),
    hits AS (SELECT doc_id, item, k, i FROM places JOIN windows USING (k, s)),
    spots AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) t(j) GROUP BY 1),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
              FROM hits GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)"""
