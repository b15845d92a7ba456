"""The training-data queries, by name, and their SQL where it can be given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .class_lm import op7_class_lm
from .exact_search import OP2_SQL, op2_exact_top_k
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .line_dedup import op10_line_dedup
from .mixing import op6_mixing
from .pieces import op3_pieces
from .quality import op5_quality
from .rules import OP9_SQL, op9_quality_rules
from .sharding import op1_sharding

from .token_ids import op4_token_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_pieces": op3_pieces,
        "op4_token_ids": op4_token_ids,
        "op5_quality": op5_quality,
        "op6_mixing": op6_mixing,
        "op7_class_lm": op7_class_lm,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_quality_rules": op9_quality_rules,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": OP2_SQL,
        "op8_jaccard_join": OP8_SQL,
        "op9_quality_rules": OP9_SQL,
    }
