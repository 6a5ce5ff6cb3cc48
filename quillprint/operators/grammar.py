"""Random texts from a sentence grammar and a vocabulary table.

Every choice is the hash of (seed, sample, sentence, level, place), so a sample is the same on any partitioning. The
grammars have no recursion, so a sentence is complete after a fixed number of rewriting steps on string columns; the
words then come from one join with the vocabulary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import text as fn
from quillprint.functions.binding import let
from quillprint.operators.ordering import number_blocks
from quillprint.session import settle, spread

SLOT = r"\{([A-Z_0-9]+)\}"


def _levels(grammar: dict[str, list[str]], symbol: str = "S") -> int:
    """Rewriting steps until only words are left."""
    used = {s for form in grammar[symbol] for s in re.findall(SLOT, form) if s in grammar}
    return 1 + max((_levels(grammar, s) for s in used), default=0)


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=\})|(?=\{)"), lambda p: p != "")


def _rewrite(text: Column, grammar: dict[str, list[str]], *identity: Column) -> Column:
    """Replace every symbol of the grammar by one of its forms."""
    def choose(piece: Column, place: Column) -> Column:
        chosen = piece
        for symbol, forms in grammar.items():
            number = F.pmod(F.xxhash64(*identity, place), F.lit(len(forms)).cast("bigint")) + 1
            form = F.element_at(F.array(*[F.lit(f) for f in forms]), number.cast("int"))
            chosen = F.when(piece == f"{{{symbol}}}", form).otherwise(chosen)
        return chosen

    return F.array_join(F.transform(_pieces(text), choose), "")


def _vocabulary_slots(vocabulary: DataFrame) -> DataFrame:
    """Words of every class, numbered from 0. The vocabulary may be costly to make and is read several times here, so
    its distinct words are written out first."""
    distinct = settle(vocabulary.select("word_class", "word").distinct(), "vocabulary").withColumn(
        "_block", F.substring(F.md5(F.col("word").cast("binary")), 1, 2))
    return number_blocks(distinct, ["_block"], ["word"], "slot", group=["word_class"]).drop("_block")


def grammar_samples(samples: DataFrame, vocabulary: DataFrame, grammar: dict[str, list[str]],
                    classes: dict[str, str], target: int, shortest: int, measure: callable, joiner: str,
                    capitalize: bool, seed: int, third_person: str | None = None) -> DataFrame:
    """One text per ``sample_id``: sentences until the text measures at least ``target``.

    ``vocabulary`` has ``word_class, word``. Sentences are one array per sample until the words are needed.
    """
    most = -(-target // shortest)
    numbers = F.sequence(F.lit(0), F.lit(most - 1))
    levels = _levels(grammar)

    def sentence(number: Column) -> Column:
        text = F.lit("{S}")
        for level in range(levels):
            text = _rewrite(text, grammar, F.lit(seed), F.col("sample_id"), number, F.lit(level))
        return text

    # a slot stands for at least one unit, so the sentences needed are among those written by counting slots as one
    empty = F.struct(F.array().cast("array<string>").alias("forms"), F.lit(0).alias("units"))

    def extend(so_far: Column, number: Column) -> Column:
        longer = let(sentence(number), lambda form: F.struct(
            F.array_append(so_far["forms"], form).alias("forms"),
            (so_far["units"] + measure(F.regexp_replace(form, SLOT, "x"))).alias("units")))
        return F.when(so_far["units"] < target, longer).otherwise(so_far)

    # sample ids are few bytes and often one row group; their texts are the work
    written = spread(samples.select("sample_id")).select(
        "sample_id", F.aggregate(numbers, empty, extend, lambda done: done["forms"]).alias("forms"))
    kept = (written.select("sample_id", F.posexplode("forms").alias("sentence", "form"))
            .select("sample_id", "sentence", F.posexplode(_pieces(F.col("form"))).alias("place", "piece")))

    word_class = F.create_map(*[F.lit(x) for s, c in classes.items() for x in (f"{{{s}}}", c)])
    kept = kept.withColumn("word_class", F.try_element_at(word_class, F.col("piece")))
    slots = _vocabulary_slots(vocabulary)
    # one row per word class of the grammar
    sizes = slots.groupBy("word_class").agg(F.count(F.lit(1)).alias("class_size"))
    pick = F.pmod(F.xxhash64(F.lit(seed), "sample_id", "sentence", "place", F.lit("word")), F.col("class_size"))
    drawn = (kept.join(F.broadcast(sizes), "word_class", "left").withColumn("slot", pick)
             .join(slots, ["word_class", "slot"], "left"))
    missing = F.raise_error(F.concat(F.lit("No vocabulary for "), F.col("word_class"))).cast("string")
    word = F.coalesce(F.col("word"), missing)
    if third_person:
        word = F.when(F.col("piece") == f"{{{third_person}}}", fn.third_person(word)).otherwise(word)
    piece = F.when(F.col("word_class").isNull(), F.col("piece")).otherwise(word)

    # partitioned by sample once; both aggregates below use that
    dealt = drawn.select("sample_id", "sentence", "place", piece.alias("piece")).repartition("sample_id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"])
    sentences = dealt.groupBy("sample_id", "sentence").agg(F.array_join(in_order, "").alias("text"))
    if capitalize:
        sentences = sentences.withColumn("text", F.concat(
            F.upper(F.substring("text", 1, 1)), F.expr("substring(text, 2)")))
    rows = sentences.withColumn("units", measure(F.col("text")))
    listed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "text", "units")))
                                           .alias("all"))
    enough = F.filter("all", lambda s: F.aggregate(
        F.filter("all", lambda o: o["sentence"] < s["sentence"]), F.lit(0), lambda a, o: a + o["units"]) < target)
    return listed.select("sample_id", F.array_join(F.transform(enough, lambda s: s["text"]), joiner).alias("text"))


def english_samples(samples: DataFrame, vocabulary: DataFrame, words: int = fixed.ENGLISH_WORDS_PER_SAMPLE,
                    seed: int = 42) -> DataFrame:
    """English texts of at least ``words`` words. Word classes: nouns, verbs, adjectives."""
    return grammar_samples(samples, vocabulary, fixed.ENGLISH_GRAMMAR, fixed.ENGLISH_WORD_CLASSES, words,
                           fixed.ENGLISH_SHORTEST_SENTENCE, fn.word_count, " ", True, seed, third_person="_VERB")


def chinese_samples(samples: DataFrame, vocabulary: DataFrame, chars: int = fixed.CHINESE_CHARS_PER_SAMPLE,
                    seed: int = 42) -> DataFrame:
    """Classical Chinese texts of at least ``chars`` characters without punctuation."""
    return grammar_samples(samples, vocabulary, fixed.CHINESE_GRAMMAR, fixed.CHINESE_WORD_CLASSES, chars,
                           fixed.CHINESE_SHORTEST_SENTENCE, fn.meaningful_length, "", False, seed)
