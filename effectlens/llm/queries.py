"""The queries of the training-data operators by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from effectlens.llm import bpe, chat, contamination, lines, neardup, packing, phrases, pii, quality, spelling, substrings, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_substrings": substrings.op2_substrings,
    "op3_chat": chat.op3_chat,
    "op4_packing": packing.op4_packing,
    "op5_lines": lines.op5_lines,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_topk": topk.op9_topk,
    "op10_neardup": neardup.op10_neardup,
    "op11_spelling": spelling.op11_spelling,
    "op12_contamination": contamination.op12_contamination,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES: dict[str, str] = {"op2_substrings": substrings.SQL, "op3_chat": chat.SQL, "op9_topk": topk.SQL, "op10_neardup": neardup.SQL, "op11_spelling": spelling.SQL, "op12_contamination": contamination.SQL, "op13_phrases": phrases.SQL}
