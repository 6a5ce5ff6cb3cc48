"""The queries of this folder: each operator on its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from quillprint.llm import (ann, byte_bpe, conversation_trie, decontamination, language_id, line_dedup, lm_scoring,
                            mixing, ngram_join, secret_scan, token_alignment, toxicity, warc)
from quillprint.llm.common import table

QUERIES = {
    "op1_language_id": (lambda spark, sf: language_id.digest(table(spark, sf, "documents")), None),
    "op2_decontamination": (
        lambda spark, sf: decontamination.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
        decontamination.digest_sql()),
    "op4_line_dedup": (
        lambda spark, sf: line_dedup.digest(line_dedup.remove_boilerplate(table(spark, sf, "documents"))),
        line_dedup.digest_sql()),
    "op5_source_mixing": (lambda spark, sf: mixing.mix(table(spark, sf, "documents")), mixing.mix_sql()),
    "op6_ngram_jaccard_join": (
        lambda spark, sf: ngram_join.join_documents(table(spark, sf, "documents")), ngram_join.digest_sql()),
    "op9_toxicity": (
        lambda spark, sf: toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels")), None),
    "op10_secret_scan": (lambda spark, sf: secret_scan.digest(table(spark, sf, "documents")), None),
    "op8_lm_scoring": (
        lambda spark, sf: lm_scoring.trigram_digest(table(spark, sf, "documents")), lm_scoring.trigram_digest_sql()),
    "op8_lm_scoring_order2": (lambda spark, sf: lm_scoring.digest(table(spark, sf, "documents")), lm_scoring.digest_sql()),
    "op3_warc": (lambda spark, sf: warc.digest(table(spark, sf, "pages")), warc.digest_sql()),
    "op7_nearest_neighbours": (lambda spark, sf: ann.digest(table(spark, sf, "embeddings")), None),
    "op11_token_alignment": (
        lambda spark, sf: token_alignment.digest(
            table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("piece_bpe_32k.model")), None),
    "op12_conversation_trie": (
        lambda spark, sf: conversation_trie.digest(table(spark, sf, "conversations")), conversation_trie.digest_sql()),
    "op13_byte_bpe": (
        lambda spark, sf: byte_bpe.digest(
            table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), None),
}
