"""The queries of this folder, by name, and their SQL."""

import corpus_pipeline
from millrace.llm import clusters, conversations, decontamination, jaccard, lines, media, mixing, pii, scoring, sharding, simhash, substrings, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_lines": lines.op3_lines,
    "op4_media": media.op4_media,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_substrings": substrings.op7_substrings,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_scoring": scoring.op9_scoring,
    "op10_sharding": sharding.op10_sharding,
    "op11_clusters": clusters.op11_clusters,
    "op12_conversations": conversations.op12_conversations,
    "op13_simhash": simhash.op13_simhash,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op2_jaccard": jaccard.ORACLE, "op7_substrings": substrings.ORACLE, "op10_sharding": sharding.ORACLE, "op11_clusters": clusters.ORACLE, "op12_conversations": conversations.ORACLE}
