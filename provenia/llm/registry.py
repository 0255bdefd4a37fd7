"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from provenia.llm import bpe, compression, decision_list, exact_dedup, hard_negatives, nn_descent, packing, periodic, pii, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_rules": decision_list.op2_quality_rules,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_compression": compression.op5_compression,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_sharding": sharding.op8_sharding,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_nn_descent": nn_descent.op12_nn_descent,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op4_pii": pii.OP4_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_nn_descent": nn_descent.OP12_SQL,
}
