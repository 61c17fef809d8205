"""Operators for preparing training data, each with its registered query.

Functions that run in tasks travel with their code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

from reachline.llm import (
    collocations,
    conversations,
    decontaminate,
    fingerprints,
    licenses,
    mixing,
    near_dedup,
    packing,
    quality,
    repeats,
    topk,
    url_filters,
    warc,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_top_k": topk.op4_top_k,
    "op5_licenses": licenses.op5_licenses,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_repeats": repeats.op10_repeats,
    "op11_collocations": collocations.op11_collocations,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

ORACLES = {
    "op1_url_filters": url_filters.ORACLE_SQL,
    "op2_mixing": mixing.ORACLE_SQL,
    "op4_top_k": topk.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_conversation_repair": conversations.ORACLE_SQL,
    "op13_decontaminate": decontaminate.ORACLE_SQL,
}
