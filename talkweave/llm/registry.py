"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .bloom_dedup import OP3_SQL, op3_exact_dedup
from .langid import op8_language_id
from .mixing import OP6_SQL, op6_source_mixing
from .ogg import OP5_SQL, op5_ogg
from .paragraphs import op7_paragraph_dedup
from .quality import op1_quality_fm
from .simhash_forest import op10_simhash_forest
from .toxicity import op9_toxic_segments
from .warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_ogg": op5_ogg,
    "op6_source_mixing": op6_source_mixing,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_simhash_forest": op10_simhash_forest,
}
ORACLES: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op5_ogg": OP5_SQL, "op6_source_mixing": OP6_SQL}
