"""Queries of the training-data operators, by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.decontam import op4_tiling_decontam
from quillstack.llm.langid import op9_lang_viterbi
from quillstack.llm.linededup import op10_line_edit_join
from quillstack.llm.media import op6_iso_media
from quillstack.llm.mixing import op7_mixture_tree
from quillstack.llm.neardup import op8_bagminhash
from quillstack.llm.quality import op5_quality_knn
from quillstack.llm.suffix import op1_suffix_dedup
from quillstack.llm.tokens import op2_token_dac
from quillstack.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_dac": op2_token_dac,
    "op3_toxicity": op3_toxicity,
    "op4_tiling_decontam": op4_tiling_decontam,
    "op5_quality_knn": op5_quality_knn,
    "op6_iso_media": op6_iso_media,
    "op7_mixture_tree": op7_mixture_tree,
    "op8_bagminhash": op8_bagminhash,
    "op9_lang_viterbi": op9_lang_viterbi,
    "op10_line_edit_join": op10_line_edit_join,
}

ORACLES: dict[str, str] = {}
