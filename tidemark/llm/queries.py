"""The queries of this subpackage, one an operator, and SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.align import op11_alignment
from tidemark.llm.ann import op5_ann
from tidemark.llm.bpe import op6_bpe
from tidemark.llm.chat import OP9_SQL, op9_chat
from tidemark.llm.fingerprint import op4_fingerprints
from tidemark.llm.importance import op1_quality
from tidemark.llm.jaccard import op7_jaccard_join
from tidemark.llm.lines import op3_line_dedup
from tidemark.llm.mixing import op8_mixing
from tidemark.llm.pii import op10_pii
from tidemark.llm.sharding import op12_sharding
from tidemark.llm.tokens import op2_token_ids
from tidemark.llm.variants import op13_variants

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_ids": op2_token_ids,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_ann": op5_ann,
    "op6_bpe": op6_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_sharding": op12_sharding,
    "op13_variants": op13_variants,
}
ORACLES: dict[str, str] = {"op9_chat": OP9_SQL}
