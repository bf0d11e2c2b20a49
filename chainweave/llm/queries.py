"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, conversation_repair, decontamination, digest_index, fingerprints, language, near_duplicates, pii, preferences, token_counts, token_files, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op2_fingerprints": lambda s, d: fingerprints.digest(table(s, d, "documents")),
    "op3_token_files": lambda s, d: token_files.round_trip(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op4_token_counts": lambda s, d: token_counts.count_tokens(table(s, d, "documents").select("doc_id", "text"), token_counts.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))).drop("text"),
    "op5_preferences": lambda s, d: preferences.replies(table(s, d, "conversations")),
    "op6_pii": lambda s, d: pii.digest(table(s, d, "documents")),
    "op7_decontamination": lambda s, d: decontamination.digest(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_bpe": lambda s, d: bpe.digest(table(s, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op9_near_duplicates": lambda s, d: near_duplicates.classes(table(s, d, "documents")),
    "op10_language": lambda s, d: language.identify(table(s, d, "documents")),
    "op11_alignment": lambda s, d: alignment.digest(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "op12_copies": lambda s, d: digest_index.copies(table(s, d, "documents")),
    "op13_conversation_repair": lambda s, d: conversation_repair.digest(table(s, d, "conversations")),
}

SQL: dict[str, str] = {"op5_preferences": preferences.REPLIES_SQL, "op12_copies": digest_index.COPIES_SQL, "op13_conversation_repair": conversation_repair.REPAIR_SQL}
