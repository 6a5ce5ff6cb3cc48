"""The given tables in the shape the operators take, once for Spark and once as SQL text for the check engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.operators.reduce import gaussian_rows
from quillprint.session import read_spread

W = fixed.WHITESPACE_RE2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def heavy_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to process."""
    return read_spread(spark, f"{sf}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def r6_far_from_ties(column: Column | str) -> Column:
    """What :func:`r6` gives of a double, without its decimals where no tie is near: of a value below a thousand the
    product is off by less than the millionth that parts it from a tie, and a whole number over a million is the double
    next to the decimal."""
    value = F.col(column) if isinstance(column, str) else column
    scaled = value * 1e6
    near = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6
    return F.when((F.abs(value) < 1e3) & ~near, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(r6(value))


def words_sql(text: str) -> str:
    """Lower-cased words."""
    return f"regexp_extract_all(lower({text}), '[^{W}]+')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{W}]+|[{W}]+$', '', 'g')"


def word_count_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{W}]+'))"


def case_sql(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains_any_sql(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in patterns) + ")"


# --- embeddings: label = model, vec_id = probe ---

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_name"),
        F.col("vec_id").alias("probe_idx"), "embedding")


EMBEDDINGS_SQL = """
    emb AS (SELECT 'model-' || label AS model_name, vec_id AS probe_idx, CAST(embedding AS DOUBLE[]) AS e
            FROM embeddings)
"""


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("sig-"), F.col("vec_id").cast("string")).alias("model_name"), F.col("vec_id").alias("ord"),
        F.col("embedding").cast("array<double>").alias("signature"), "label")


SIGNATURES_SQL = """
    sig AS (SELECT 'sig-' || vec_id AS model_name, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS s, label
            FROM embeddings)
"""


def matrix_sql(rows: int, width: int, seed: int = 42) -> str:
    """The standard normal matrix as a constant list of lists."""
    values = gaussian_rows(rows, width, seed)
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in values) + "]"


def reduced_sql(source: str, keys: str, dim: int, width: int, seed: int = 42, name: str = "") -> str:
    """CTEs from ``source(keys, probe_idx, e)`` to ``proj(keys, rank, c, y, n, k)``: every projected component."""
    p = name
    return f"""
    {p}long AS (SELECT {keys}, probe_idx, j, e[j] AS x FROM {source}, range(1, {width} + 1) t(j)),
    {p}mom AS (SELECT {keys}, j, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s0 FROM {p}long GROUP BY {keys}, j),
    {p}momf AS (SELECT {keys}, j, n, m, CASE WHEN s0 * s0 <= n * 2.220446049250313e-16 * s0 * s0
                + (n * m * 2.220446049250313e-16) * (n * m * 2.220446049250313e-16) THEN 1 ELSE s0 END AS s
                FROM {p}mom),
    {p}std AS (SELECT {keys}, probe_idx, j, n, (x - m) / s AS z, least(n - 1, {width}, {dim}) AS k
               FROM {p}long JOIN {p}momf USING ({keys}, j)),
    {p}mat AS (SELECT {matrix_sql(min(dim, width), width, seed)} AS g),
    {p}ranked AS (SELECT {keys}, probe_idx, row_number() OVER (PARTITION BY {keys} ORDER BY probe_idx) - 1 AS rank
                  FROM (SELECT DISTINCT {keys}, probe_idx FROM {source})),
    {p}proj AS (SELECT {keys}, probe_idx, c - 1 AS c, any_value(k) AS k, any_value(n) AS n,
                       sum(z * g[c][j]) / sqrt(any_value(k)) AS y
                FROM {p}std, {p}mat, range(1, {min(dim, width)} + 1) u(c) WHERE c <= k GROUP BY {keys}, probe_idx, c)
    """


def concat_sql(keys: str, dim: int, name: str = "") -> str:
    """From the CTEs of :func:`reduced_sql` to one row per signature position that is filled."""
    p = name
    return f"""SELECT {keys}, CAST(rank * k + c AS BIGINT) AS pos, round(y, 6) + 0.0 AS value
               FROM {p}proj JOIN {p}ranked USING ({keys}, probe_idx) WHERE rank * k + c < {dim}"""


def long_signature(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, pos, value`` of the signature column."""
    return df.select(*keys, F.posexplode("signature").alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


# --- conversations: user turn = prompt, next turn by the assistant = response ---

def turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, probe_idx, model_name, prompt, response``: question and answer of each exchange."""
    all_turns = table(spark, sf, "conversations")
    asked = all_turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = all_turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("probe_idx"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("model_name"),
        F.lit("chat").alias("dataset"), "prompt", "response")


TURNS_SQL = """
    turns AS (SELECT q.conv_id, q.turn // 2 AS probe_idx, 'conv-' || q.conv_id AS model_name, 'chat' AS dataset,
                     q.text AS prompt, a.text AS response
              FROM conversations q LEFT JOIN conversations a
                ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
              WHERE q.role = 'user')
"""


# --- part: composed model names. One expression, valid in both engines ---

ORGS = "meta-llama/,google/,openai/,anthropic/claude-,deepseek/,,,Qwen/,mistralai/,microsoft/,bigcode/"
FAMILIES = ("Llama-3,bert-base,roberta-large,gpt2,Mistral,Qwen2.5,gemma,phi-3,falcon,bloom,pythia,flan-t5,bart,ul2,"
            "deberta,electra,code-model,gpt-neo,mixtral-8x7,janus,gpt-4o,gemini-1.5,opt,distilgpt2,vicuna")
UNITS = "b,m,b-chat,b-Instruct,m-it,,_8bit,.5b,billion"
NAME_EXPR = (
    f"split_part('{ORGS}', ',', CAST(p_size % 11 + 1 AS INT)) || "
    f"split_part('{FAMILIES}', ',', CAST(p_partkey % 25 + 1 AS INT)) || '-' || p_size || "
    f"split_part('{UNITS}', ',', CAST(p_partkey % 9 + 1 AS INT)) || '-v' || p_partkey")
CONFIG_EXPR = """CASE p_partkey % 6
    WHEN 0 THEN '{"architectures":["LlamaForCausalLM"],"model_type":"llama","hidden_size":4096,"num_hidden_layers":'
                || p_size || ',"vocab_size":32000,"torch_dtype":"bfloat16"}'
    WHEN 1 THEN '{"architectures":["BertForMaskedLM"],"model_type":"bert","num_parameters":' || p_size || '00000000}'
    WHEN 2 THEN '{"architectures":["T5ForConditionalGeneration"],"model_type":"t5","chat_template":"x"}'
    WHEN 3 THEN '{"architectures":["SomeModel"],"model_type":""}'
    WHEN 4 THEN '{"architectures":[],"model_type":"gemma","total_params":' || p_size || '000000}'
    ELSE NULL END"""


def models(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.expr(NAME_EXPR).alias("model_name"), F.expr(CONFIG_EXPR).alias("config"),
        (F.col("p_partkey") % 4 == 0).alias("has_tokenizer_template"), (F.col("p_size") % 5 == 0).alias("is_gated"),
        F.floor("p_retailprice").alias("downloads"), "p_size", "p_type", "p_brand")


MODELS_SQL = f"""
    models AS (SELECT p_partkey AS ord, {NAME_EXPR} AS model_name, {CONFIG_EXPR} AS config,
                      p_partkey % 4 = 0 AS has_tokenizer_template, p_size % 5 = 0 AS is_gated,
                      CAST(floor(p_retailprice) AS BIGINT) AS downloads, p_size, p_type, p_brand
               FROM part)
"""


# --- documents: lang = dataset, doc_id = position ---

def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("probe_idx"),
                                                "text")


def vocabulary(spark: SparkSession, sf: str, classes: list[str]) -> DataFrame:
    """Words of the documents, dealt out to word classes by their hash."""
    from quillprint.operators.textstats import vocabulary as distinct_words
    words = distinct_words(heavy_table(spark, sf, "documents"))
    names = F.array(*[F.lit(c) for c in classes])
    place = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(len(classes)).cast("bigint")) + 1
    return words.select(F.element_at(names, place.cast("int")).alias("word_class"), "word")
