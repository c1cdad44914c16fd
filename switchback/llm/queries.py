"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op2_bpe
from .codes import OP13_SQL, op13_vector_codes
from .license_scan import op6_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import OP5_SQL, op5_ngram_jaccard
from .packing import op7_packing
from .quality_rules import OP10_SQL, op10_quality_rules
from .repeats import OP11_SQL, op11_suffix_dedup
from .resampling import op4_quality_classifier
from .tool_links import OP8_SQL, op8_tool_links
from .topk import OP1_SQL, op1_topk
from .turns import OP12_SQL, op12_conversation_repair
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_tool_links": op8_tool_links,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op1_topk": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op8_tool_links": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
