"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from scriptorium.llm.dual_tree import OP13_SQL, op13_dual_tree
from scriptorium.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from scriptorium.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from scriptorium.llm.filter_audit import OP12_SQL, op12_filter_audit
from scriptorium.llm.histogram_sort import op3_sharding
from scriptorium.llm.langid import op5_language_id
from scriptorium.llm.minhash import OP9_SQL, op9_minhash
from scriptorium.llm.mixing import OP1_SQL, op1_mixing
from scriptorium.llm.packing import op11_packing
from scriptorium.llm.pieces import op7_pieces
from scriptorium.llm.quality import op10_quality
from scriptorium.llm.toxicity import op4_toxicity
from scriptorium.llm.transcripts import op8_chat_formatting

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pieces": op7_pieces,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_dual_tree": op13_dual_tree,
}

ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_minhash": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_dual_tree": OP13_SQL,
}
