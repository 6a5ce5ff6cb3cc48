"""What a model's name and configuration say about it.

Rules are tried in a fixed order and the first match wins, so each one is a CASE chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions.binding import let
from quillprint.functions.text import any_contained


def _first_match(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    condition, value = cases[0]
    chain = F.when(condition, value)
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def provider(name: Column) -> Column:
    lowered = F.lower(name)
    cases = [(_starts_with_any(lowered, prefixes), F.lit(who)) for who, prefixes in fixed.PROVIDER_PREFIXES]
    return _first_match(cases, F.lit(fixed.DEFAULT_PROVIDER))


def is_api_provider(kind: Column) -> Column:
    return kind.isin(*fixed.API_PROVIDERS)


def family(name: Column) -> Column:
    """struct<family, architecture, organization>, null when no family is known."""
    lowered = F.lower(name)
    return _first_match([
        (F.contains(lowered, F.lit(fam)),
         F.struct(F.lit(fam).alias("family"), F.lit(arch).alias("architecture"), F.lit(org).alias("organization")))
        for fam, arch, org in fixed.MODEL_FAMILIES
    ])


def family_organization(model_type: Column) -> Column:
    """Organization of a configured model type, null when it is no known family."""
    return _first_match([(model_type == fam, F.lit(org)) for fam, _, org in fixed.MODEL_FAMILIES])


def name_organization(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", 1)).otherwise(F.lit("unknown"))


def family_and_organization(name: Column, model_type: Column) -> Column:
    """struct<family, organization>: the configured type first, then the name."""
    configured = F.coalesce(model_type, F.lit("")) != ""
    by_type = F.struct(
        model_type.alias("family"),
        F.coalesce(family_organization(model_type), name_organization(name)).alias("organization"))
    found = family(name)
    by_name = F.struct(
        F.coalesce(found["family"], F.lit("unknown")).alias("family"),
        F.coalesce(found["organization"], name_organization(name)).alias("organization"))
    return F.when(configured & (model_type != "unknown"), by_type).otherwise(by_name)


def architecture_from_name(name: Column) -> Column:
    lowered = F.lower(name)
    return _first_match([
        (any_contained(lowered, fixed.ENCODER_DECODER_NAMES), F.lit("encoder_decoder")),
        (any_contained(lowered, fixed.ENCODER_ONLY_NAMES), F.lit("encoder_only")),
        (any_contained(lowered, fixed.DECODER_ONLY_NAMES), F.lit("decoder_only")),
    ], F.lit(fixed.DEFAULT_ARCHITECTURE))


def _class_rules(class_name: Column, encoder_classes: list[str]) -> list[tuple[Column, Column]]:
    return [
        (any_contained(class_name, fixed.CONFIG_DECODER_CLASSES), F.lit("decoder_only")),
        (any_contained(class_name, fixed.CONFIG_ENCODER_DECODER_CLASSES), F.lit("encoder_decoder")),
        (any_contained(class_name, encoder_classes) & ~F.contains(class_name, F.lit("CausalLM")),
         F.lit("encoder_only")),
    ]


def architecture_from_class(class_name: Column) -> Column:
    """Architecture from the first configured class; decoder where it says nothing."""
    return _first_match(_class_rules(class_name, fixed.CONFIG_ENCODER_CLASSES), F.lit(fixed.DEFAULT_ARCHITECTURE))


def catalog_architecture(class_name: Column, model_type: Column) -> Column:
    """The catalog's rule: any class named Model counts as encoder, then the model type decides."""
    cases = _class_rules(class_name, fixed.CONFIG_ENCODER_CLASSES_CATALOG) + [
        (model_type.isin(*fixed.CONFIG_ENCODER_TYPES), F.lit("encoder_only")),
        (model_type.isin(*fixed.CONFIG_ENCODER_DECODER_TYPES), F.lit("encoder_decoder")),
        (model_type.isin(*fixed.CONFIG_DECODER_TYPES), F.lit("decoder_only")),
    ]
    return _first_match(cases, F.lit("unknown"))


def is_generative(architecture: Column) -> Column:
    return F.coalesce(architecture.isin(*fixed.GENERATIVE_ARCHITECTURES), F.lit(False))


def has_chat_name(name: Column) -> Column:
    return any_contained(F.lower(name), fixed.CHAT_NAME_PATTERNS)


def chat_info(name: Column, tokenizer_template: Column, config_template: Column) -> Column:
    """struct<is_chat_model, chat_indicators, confidence>; a tokenizer template hides a configured one."""
    in_tokenizer = F.coalesce(tokenizer_template, F.lit(False))
    in_config = F.coalesce(config_template, F.lit(False)) & ~in_tokenizer
    in_name = has_chat_name(name)
    indicators = F.array_sort(F.array_compact(F.array(
        F.when(in_tokenizer, F.lit(fixed.CHAT_INDICATOR_TOKENIZER)),
        F.when(in_config, F.lit(fixed.CHAT_INDICATOR_CONFIG)),
        F.when(in_name, F.lit(fixed.CHAT_INDICATOR_NAME)))))
    confidence = (F.when(in_tokenizer | in_config, F.lit("high")).when(in_name, F.lit("medium"))
                  .otherwise(F.lit("low")))
    return F.struct((in_tokenizer | in_config | in_name).alias("is_chat_model"),
                    indicators.alias("chat_indicators"), confidence.alias("confidence"))


def size_category(billions: Column) -> Column:
    cases = [(billions < bound, F.lit(label)) for bound, label in fixed.SIZE_CATEGORIES]
    return F.when(billions.isNull(), F.lit("unknown")).otherwise(
        _first_match(cases, F.lit(fixed.LARGEST_SIZE_CATEGORY)))


def _size_in_name(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """struct<count, billions> of the first pattern found in the lower-cased name, null fields when none is."""
    lowered = F.lower(name)
    # factor to a count, divisor to billions
    scale = {"b": (1e9, 1.0), "m": (1e6, 1000.0)}
    first = F.coalesce(*[
        F.when(lowered.rlike(pattern), F.struct(
            F.regexp_extract(lowered, pattern, 1).try_cast("double").alias("number"),
            F.lit(scale[unit][0]).alias("factor"), F.lit(scale[unit][1]).alias("divisor")))
        for pattern, unit in patterns])
    return let(first, lambda f: F.struct((f["number"] * f["factor"]).cast("bigint").alias("count"),
                                         (f["number"] / f["divisor"]).alias("billions")))


def parameter_info(name: Column, config: Column | None = None) -> Column:
    """struct<parameter_count, parameter_count_billions, size_category, source>.

    ``config`` is a VARIANT. A count in it comes first, then one computed from its layer sizes, then the name.
    The category looks at the exact size, the reported size of a configured count is rounded.
    """
    def answer(count: Column, billions: Column, category: Column, source: str) -> Column:
        return F.struct(count.alias("parameter_count"), billions.alias("parameter_count_billions"),
                        category.alias("size_category"), F.lit(source).alias("source"))

    def field(key: str) -> Column:
        missing = F.lit(None).cast("bigint")
        return missing if config is None else F.try_variant_get(config, f"$.{key}", "bigint")

    def computed(layers: Column) -> Column:
        return 12 * layers["layers"] * layers["hidden"] * layers["hidden"] + layers["vocab"] * layers["hidden"]

    sizes = F.struct(field("num_hidden_layers").alias("layers"), field("hidden_size").alias("hidden"),
                     field("vocab_size").alias("vocab"))
    known = F.struct(
        F.coalesce(*[field(key) for key in fixed.CONFIG_COUNT_FIELDS]).alias("stated"),
        let(sizes, computed).alias("computed"), _size_in_name(name, fixed.SIZE_PATTERNS).alias("named"))

    def choose(k: Column) -> Column:
        def counted(count: Column, source: str) -> Column:
            return answer(count, F.round(count / 1e9, 2), size_category(count / 1e9), source)

        named = k["named"]
        return (F.when(k["stated"].isNotNull(), counted(k["stated"], "config"))
                .when(k["computed"].isNotNull(), counted(k["computed"], "calculated"))
                .when(named["count"].isNotNull(),
                      answer(named["count"], named["billions"], size_category(named["billions"]), "name_pattern"))
                .otherwise(answer(F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit("unknown"),
                                  "not_available")))

    return let(known, choose)


def batch_class(name: Column, billions: Column | None = None) -> Column:
    """struct<size_class, batch_size> from a known size, else from the name."""
    named = _size_in_name(name, fixed.BATCH_SIZE_PATTERNS)["billions"]

    def answer(label: str, batch: int) -> Column:
        return F.struct(F.lit(label).alias("size_class"), F.lit(batch).alias("batch_size"))

    def choose(size: Column) -> Column:
        cases = [(size >= bound, answer(label, batch)) for bound, label, batch in fixed.BATCH_CLASSES]
        cases.append((size.isNotNull(), answer(*fixed.DEFAULT_BATCH_CLASS)))
        return _first_match(cases, answer(*fixed.UNKNOWN_BATCH_CLASS))

    return let(named if billions is None else F.coalesce(billions, named), choose)


def is_large(name: Column) -> Column:
    return any_contained(F.lower(name), fixed.LARGE_NAMES)


def is_likely_large(name: Column) -> Column:
    return any_contained(F.lower(name), fixed.LARGE_NAMES + fixed.LIKELY_LARGE_EXTRA_NAMES)


def needs_trusted_code(name: Column) -> Column:
    return any_contained(F.lower(name), fixed.TRUST_CODE_NAMES)


def is_unsupported(name: Column) -> Column:
    return any_contained(F.lower(name), fixed.UNSUPPORTED_NAMES)


def quantization(billions: Column, in_8bit: Column, in_4bit: Column, none: Column) -> Column:
    """Explicit flags win; otherwise 8 bit from 7 billion parameters on. Contradicting flags are an error."""
    flags = in_8bit.cast("int") + in_4bit.cast("int") + none.cast("int")
    return (F.when(flags > 1, F.raise_error(F.lit("Use only one of load_in_4bit, load_in_8bit, no_quantization"))
                   .cast("string"))
            .when(in_4bit, F.lit("4bit")).when(in_8bit, F.lit("8bit")).when(none, F.lit("none"))
            .when(billions >= fixed.AUTO_8BIT_BILLIONS, F.lit("8bit")).otherwise(F.lit("none")))


def memory_gb(name: Column, precision: Column) -> Column:
    factor = (F.when(precision == "float32", 2.0).when(precision == "float16", 1.0)
              .when(F.contains(precision, F.lit("8bit")), 0.5).when(F.contains(precision, F.lit("4bit")), 0.25))
    lowered = F.lower(name)
    cases = [(F.contains(lowered, F.lit(key)) & factor.isNotNull(), F.lit(gb) * factor)
             for key, gb in fixed.MEMORY_GB]
    return _first_match(cases, F.lit(fixed.DEFAULT_MEMORY_GB))


def context_budget(context: Column, requested: Column) -> Column:
    """struct<input_tokens, new_tokens>: half the context at most for output, 64 tokens at least for input."""
    total = F.coalesce(context, F.lit(fixed.DEFAULT_CONTEXT))
    half = F.floor(total / 2).cast("int")
    new = F.least(requested, half)
    room = total - new
    tight = room < fixed.MIN_INPUT_TOKENS
    least = F.lit(fixed.MIN_INPUT_TOKENS)
    return F.struct(
        F.when(tight, least).otherwise(room).cast("int").alias("input_tokens"),
        F.when(tight, F.greatest(F.lit(1), total - least)).otherwise(new).cast("int").alias("new_tokens"))


def wants_chat_template(rule: str, use_flag: Column, has_template: Column, name: Column, chat_flag: Column) -> Column:
    """Whether a prompt goes through the chat template. The three callers decide slightly differently.

    ``probes``: flagged as chat, or flag unknown. ``wrapper``: chat-like name. ``generate``: flag, name or template.
    """
    has = F.coalesce(has_template, F.lit(False))
    lowered = F.lower(name)
    if rule == "probes":
        return use_flag & has & F.coalesce(chat_flag, F.lit(True))
    if rule == "wrapper":
        return has & any_contained(lowered, fixed.CHAT_TEMPLATE_NAME_PATTERNS)
    if rule == "generate":
        named = any_contained(lowered, fixed.CHAT_GENERATE_NAME_PATTERNS)
        return use_flag & has & (F.coalesce(chat_flag, F.lit(False)) | named | has)
    raise ValueError(f"Unknown chat template rule: {rule}")


def apply_chat_template(prompt: Column, template: str, wanted: Column) -> Column:
    """Fill a literal template (one ``{}``) where the decision says so."""
    before, after = template.split("{}", 1)
    return F.when(wanted, F.concat(F.lit(before), prompt, F.lit(after))).otherwise(prompt)
