"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillgraph.llm.decontamination import ORACLE_OP6, op6_decontamination
from quillgraph.llm.fingerprints import op7_improbable_features
from quillgraph.llm.near_dedup import ORACLE_OP9, op9_hyperminhash
from quillgraph.llm.pii import op10_bootstrapped_pii
from quillgraph.llm.quality import op4_attention_mil
from quillgraph.llm.secret_scan import op2_randomness_battery
from quillgraph.llm.sentencepiece_codec import op5_streaming_viterbi
from quillgraph.llm.sharding import op3_prefix_shards
from quillgraph.llm.substring_dedup import op8_sentence_spans
from quillgraph.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_randomness_battery": op2_randomness_battery,
    "op3_prefix_shards": op3_prefix_shards,
    "op4_attention_mil": op4_attention_mil,
    "op5_streaming_viterbi": op5_streaming_viterbi,
    "op6_decontamination": op6_decontamination,
    "op7_improbable_features": op7_improbable_features,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_hyperminhash": op9_hyperminhash,
    "op10_bootstrapped_pii": op10_bootstrapped_pii,
}

ORACLE_SQL = {
    "op6_decontamination": ORACLE_OP6,
    "op9_hyperminhash": ORACLE_OP9,
}
