"""Text functions as Column expressions.

Whitespace is the Unicode set, spelled out, because ``\\s`` in Java covers ASCII only. Words are maximal runs of
anything else, so an empty text has no words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions.binding import let

SPACE = f"[{fixed.WHITESPACE}]"
WORD = f"[^{fixed.WHITESPACE}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.WHITESPACE_CHARS))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def has_text(text: Column) -> Column:
    """True when a text is neither null nor blank."""
    return F.coalesce(text.rlike(f"[^{fixed.WHITESPACE}]"), F.lit(False))


def any_contained(text: Column, patterns: list[str]) -> Column:
    """True when the text contains any of the patterns, case-sensitively."""
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in patterns])


def clean_text(text: Column) -> Column:
    """Runs of whitespace become one space, ends are stripped, control characters go last."""
    collapsed = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.regexp_replace(collapsed, r"[\x00-\x1f]", "")


def alnum_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return letters / F.length(text)


def is_valid_probe(text: Column) -> Column:
    """The quality rule for a probe text: long enough, 2 to 100 words, no letter runs, mostly alphanumeric."""
    run = r"(?i)([a-z])\1{%d}" % fixed.PROBE_MAX_LETTER_RUN
    # cheap tests first: a text that fails one is not looked at again
    return F.coalesce(
        (F.length(strip(text)) >= fixed.PROBE_MIN_CHARS)
        & let(word_count(text), lambda n: n.between(fixed.PROBE_MIN_WORDS, fixed.PROBE_MAX_WORDS))
        & (alnum_ratio(text) >= fixed.PROBE_MIN_ALNUM_RATIO)
        & ~text.rlike(run), F.lit(False))


def is_question(text: Column) -> Column:
    return F.endswith(strip(text), F.lit("?"))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def complexity(text: Column) -> Column:
    return (F.length(text) + fixed.COMMA_WEIGHT * occurrences(text, ",")
            + fixed.SEMICOLON_WEIGHT * occurrences(text, ";"))


def mentions_domain(lowered: Column, domain: str) -> Column:
    """Lower-cased text against the keywords as written: a keyword with capitals never matches."""
    return any_contained(lowered, fixed.DOMAIN_KEYWORDS[domain])


def meaningful_length(text: Column) -> Column:
    """Characters other than the full-width punctuation marks."""
    return F.length(F.translate(text, fixed.CJK_PUNCTUATION, ""))


def normalize_model_name(name: Column) -> Column:
    return F.lower(F.translate(name, "/\\: -", "_____"))


def safe_filename(name: Column) -> Column:
    replaced = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), "_+", "_")
    trimmed = F.regexp_replace(replaced, r"^[_.]+|[_.]+$", "")
    return F.when(trimmed == "", F.lit("unnamed")).otherwise(trimmed)


def model_key(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def dataset_key(dataset: Column) -> Column:
    return F.translate(dataset, ",", "_")


def signature_file(root: str, dataset: Column, name: Column) -> Column:
    """Where a signature file goes: root / dataset / model / model_dna.json."""
    key = model_key(name)
    file = F.concat(key, F.lit(f"{fixed.SIGNATURE_FILE_SUFFIX}.json"))
    return F.concat_ws("/", F.lit(root), dataset_key(dataset), key, file)


def response_file(root: str, dataset: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(root), dataset_key(dataset), model_key(name), F.lit(fixed.RESPONSES_FILE))


def probe_cache_key(dataset: Column, count: Column, seed: Column) -> Column:
    safe = F.regexp_replace(strip(dataset), "[^A-Za-z0-9_-]+", "_")
    return F.concat(F.lit(fixed.PROBE_CACHE_PREFIX), safe, F.lit("_n"), count.cast("string"), F.lit("_seed"), seed.cast("string"))


def probe_set_id(dataset: Column, count: Column) -> Column:
    return F.concat(dataset, F.lit("_"), count.cast("string"))


def extraction_method(reduction: Column, merge: Column) -> Column:
    return F.concat(F.lit(fixed.EXTRACTION_METHOD_PREFIX), reduction, F.lit("_"), merge)


def normalized_method(method: Column, normalization: str) -> Column:
    return F.concat(method, F.lit(f"{fixed.NORMALIZED_MARK}{normalization}"))


def catalog_file_stem(stem: Column) -> Column:
    """Name of the catalog file that belongs to a model-list file, both without extension."""
    lowered = F.lower(stem)
    chosen = F.when(F.contains(lowered, F.lit(fixed.MODEL_LIST_STEM)),
                    F.regexp_replace(stem, f"(?i){fixed.MODEL_LIST_STEM}", fixed.CATALOG_STEM))
    for ending, replacement in fixed.LIST_ENDINGS:
        kept = F.substring(stem, F.lit(1), F.length(stem) - len(ending))
        chosen = chosen.when(F.endswith(lowered, F.lit(ending)), F.concat(kept, F.lit(replacement)))
    plain = (stem != "") & ~F.contains(lowered, F.lit(fixed.CATALOG_MARK))
    return (chosen.when(plain, F.concat(stem, F.lit(f"_{fixed.CATALOG_MARK}")))
            .otherwise(F.lit(fixed.CATALOG_STEM)))


def third_person(verb: Column) -> Column:
    return (F.when(verb.rlike("(s|sh|ch|x|z|o)$"), F.concat(verb, F.lit("es")))
            .when(verb.rlike("(^|[^aeou])y$"), F.concat(F.regexp_replace(verb, "y$", ""), F.lit("ies")))
            .otherwise(F.concat(verb, F.lit("s"))))


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def dataset_name(dataset: Column) -> Column:
    """Full dataset name of a short id; an unknown id stands for itself."""
    return F.coalesce(F.try_element_at(_literal_map(fixed.DATASET_ALIASES), dataset), dataset)


def dataset_names(spec: Column) -> Column:
    """Comma-separated dataset spec to full names; a spec without a comma is looked up as it is."""
    many = F.transform(F.split(spec, ","), lambda part: dataset_name(strip(part)))
    return F.when(F.contains(spec, F.lit(",")), many).otherwise(F.array(dataset_name(spec)))
