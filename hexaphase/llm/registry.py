"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_html as op1
from . import op10_suffix_dedup as op10
from . import op11_repair as op11
from . import op12_alignment as op12
from . import op13_ngram_join as op13
from . import op2_exact_dedup as op2
from . import op3_sentencepiece as op3
from . import op4_lm as op4
from . import op5_simhash as op5
from . import op6_sharding as op6
from . import op7_quality as op7
from . import op8_mixing as op8
from . import op9_fingerprints as op9


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_html": op1.op1_html,
        "op2_exact_dedup": op2.op2_exact_dedup,
        "op3_sentencepiece": op3.op3_sentencepiece,
        "op4_lm": op4.op4_lm,
        "op5_simhash": op5.op5_simhash,
        "op6_sharding": op6.op6_sharding,
        "op7_quality": op7.op7_quality,
        "op8_mixing": op8.op8_mixing,
        "op9_fingerprints": op9.op9_fingerprints,
        "op10_suffix_dedup": op10.op10_suffix_dedup,
        "op11_repair": op11.op11_repair,
        "op12_alignment": op12.op12_alignment,
        "op13_ngram_join": op13.op13_ngram_join,
    }
    if importlib.util.find_spec("corpus_pipeline") is not None:
        found["pipeline"] = _pipeline
    return found


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": op2.ORACLE_SQL}
