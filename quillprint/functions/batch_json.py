"""Reading loosely typed batch JSON through VARIANT columns: a wrong shape is a null, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions.text import strip


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def field(document: Column, path: str) -> Column:
    return F.try_variant_get(document, f"$.{path}", "variant")


def kind(value: Column) -> Column:
    """string, array, object, null or another scalar name; SQL null where the value is missing."""
    schema = F.schema_of_variant(value)
    return (F.when(value.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(value), F.lit("null"))
            .when(F.startswith(schema, F.lit("OBJECT")), F.lit("object"))
            .when(F.startswith(schema, F.lit("ARRAY")), F.lit("array"))
            .otherwise(F.lower(schema)))


def string_field(document: Column, path: str) -> Column:
    """The field when it is a JSON string, else null."""
    value = field(document, path)
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))


def array_field(document: Column, path: str) -> Column:
    value = field(document, path) if path else document
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def object_field(document: Column, path: str) -> Column:
    value = field(document, path)
    return F.when(kind(value) == "object", value)


def _joined_texts(parts: Column) -> Column:
    texts = F.filter(F.transform(parts, lambda p: string_field(p, "text")), lambda t: t.isNotNull())
    return strip(F.array_join(texts, "\n"))


def choice_text(choice: Column) -> Column:
    """Text of one choice: a string, or the text parts of a list, stripped."""
    return F.coalesce(strip(string_field(choice, "message.content")),
                      _joined_texts(array_field(choice, "message.content")), F.lit(""))


def candidate_text(response: Column) -> Column:
    """Text of a response with candidates: its own text first, else the parts of the first candidate."""
    return F.coalesce(strip(string_field(response, "text")),
                      _joined_texts(array_field(response, "candidates[0].content.parts")), F.lit(""))


def prompt_index(custom_id: Column) -> Column:
    """The number behind the id prefix, null when the id has another form."""
    pattern = f"^{fixed.BATCH_ID_PREFIX}\\s*([+-]?\\d+(?:_\\d+)*)\\s*$"
    digits = F.nullif(F.regexp_replace(F.regexp_extract(custom_id, pattern, 1), "_", ""), F.lit(""))
    return digits.try_cast("bigint")


def blank(value: Column) -> Column:
    """Whether a value counts as no answer: missing, null, false, zero, an empty text, object or array."""
    return value.isNull() | F.to_json(value).isin("null", "false", "0", "0.0", '""', "{}", "[]")


def request_key(value: Column) -> Column:
    """An integer key given as number or as string; a number with a fraction part, even zero, is none."""
    whole = ~F.coalesce(F.to_json(value).rlike(r"^-?[0-9.]*[.eE]"), F.lit(False)) & ~F.rlike(
        F.coalesce(kind(value), F.lit("null")), F.lit("decimal|double|float"))
    text = F.when((kind(value) != "null") & whole, F.try_variant_get(value, "$", "string"))
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text)).try_cast("bigint")


def job_state(info: Column) -> Column:
    """State of a batch job, wherever it is put: in the metadata or at the top, as a string or in an object."""
    places = []
    for path in ("metadata.state", "state"):
        places.append(string_field(info, path))
        places += [string_field(info, f"{path}.{key}") for key in ("name", "state", "code")]
    return F.coalesce(*places)


def reasoning_text(message: Column) -> Column:
    """Answer text; when blank, the reasoning; when that is blank too, the first detail that has text."""
    def filled(value: Column) -> Column:
        return F.when(strip(value) != "", strip(value))

    details = F.transform(array_field(message, "reasoning_details"), lambda d: filled(string_field(d, "text")))
    first_detail = F.try_element_at(F.filter(details, lambda t: t.isNotNull()), F.lit(1))
    return F.coalesce(filled(string_field(message, "content")), filled(string_field(message, "reasoning")),
                      first_detail, F.lit(""))


def cached_response(item: Column) -> Column:
    """Response of one cached item: missing is empty, JSON null is the word None."""
    value = field(item, "response")
    return _as_text(value)


def cached_element(element: Column) -> Column:
    """Text of one element of a bare response array."""
    return _as_text(element)


def _as_text(value: Column) -> Column:
    what = kind(value)
    return (F.when(value.isNull(), F.lit("")).when(what == "null", F.lit("None"))
            .when(what == "string", F.try_variant_get(value, "$", "string"))
            .when(what == "boolean", F.initcap(F.try_variant_get(value, "$", "string")))
            .otherwise(F.to_json(value)))
