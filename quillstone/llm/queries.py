"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, line_dedup, packing, parity_join, quality_knn, quality_rules, rans, runs, simhash, spelling, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        warc.op1_warc_normaliser,
        toxicity.op2_nnpu_toxicity,
        simhash.op3_simhash_dedup,
        quality_knn.op4_knn_quality,
        decontaminate.op5_minhash_containment,
        quality_rules.op6_divergence_rules,
        packing.op7_best_fit_packing,
        line_dedup.op8_site_line_dedup,
        rans.op9_rans_tokens,
        langid.op10_naive_bayes_language,
        runs.op11_periodic_runs,
        parity_join.op12_parity_join,
        spelling.op13_spelling_variants,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_warc_normaliser": warc.OP1_SQL, "op5_minhash_containment": decontaminate.OP5_SQL, "op6_divergence_rules": quality_rules.OP6_SQL, "op8_site_line_dedup": line_dedup.OP8_SQL, "op12_parity_join": parity_join.OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
