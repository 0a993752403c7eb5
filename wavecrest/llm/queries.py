"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from wavecrest.llm.best_fit import op13_sum_of_squares_packing
from wavecrest.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from wavecrest.llm.embedding_dedup import op6_rp_forest_dedup
from wavecrest.llm.encode import op2_bpe_roundtrip
from wavecrest.llm.html_text import op10_html_text
from wavecrest.llm.jaccard import op3_jaccard_join
from wavecrest.llm.packing import op4_bm25_packing
from wavecrest.llm.periodic_runs import op12_periodic_runs
from wavecrest.llm.pii import op8_pii_tagger
from wavecrest.llm.quality_rules import op1_quality_rules
from wavecrest.llm.site_quality import op9_site_quality
from wavecrest.llm.token_counts import op7_token_counts
from wavecrest.llm.toxicity import op5_toxicity_chain

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_bm25_packing": op4_bm25_packing,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_rp_forest_dedup": op6_rp_forest_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_pii_tagger": op8_pii_tagger,
    "op9_site_quality": op9_site_quality,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_sum_of_squares_packing": op13_sum_of_squares_packing,
}

#: Learned models, tokenizers, markup, connected components and periodic runs have no SQL form; tests/llm hold them
#: against brute force.
ORACLES: dict[str, str] = {"op11_conversation_repair": OP11_SQL}
