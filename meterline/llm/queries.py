"""The registered queries of this package, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from meterline.llm.chats import OP2_SQL, op2_chat_formatting
from meterline.llm.fingerprints import OP11_SQL, op11_fingerprints
from meterline.llm.jaccard import op4_ngram_jaccard
from meterline.llm.middle import OP12_SQL, op12_middle
from meterline.llm.mixing import OP1_SQL, op1_mixing
from meterline.llm.pieces import op6_pieces
from meterline.llm.quality import op5_quality_rules
from meterline.llm.secrets import op9_secret_scans
from meterline.llm.sentences import op7_sentence_spans
from meterline.llm.sharding import OP8_SQL, op8_sharding
from meterline.llm.suffixes import op3_suffix_dedup
from meterline.llm.variants import op13_variants
from meterline.llm.vectors import op10_near_vectors

QUERIES = {
    query.__name__: query
    for query in (
        op1_mixing,
        op2_chat_formatting,
        op3_suffix_dedup,
        op4_ngram_jaccard,
        op5_quality_rules,
        op6_pieces,
        op7_sentence_spans,
        op8_sharding,
        op9_secret_scans,
        op10_near_vectors,
        op11_fingerprints,
        op12_middle,
        op13_variants,
    )
}
ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op8_sharding": OP8_SQL,
    "op11_fingerprints": OP11_SQL,
    "op12_middle": OP12_SQL,
}
