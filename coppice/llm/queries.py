"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from coppice.llm.bpe import op9_byte_bpe
from coppice.llm.html_text import op4_html_text
from coppice.llm.packing import op8_best_fit_packing
from coppice.llm.quality import OP5_SQL, op5_quality_rules
from coppice.llm.secrets import op3_secret_scan
from coppice.llm.simhash import op7_simhash
from coppice.llm.spotsigs import op10_spotsigs
from coppice.llm.suffix_dedup import op1_suffix_dedup
from coppice.llm.toxicity import op6_toxicity
from coppice.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_spotsigs": op10_spotsigs,
}
ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op5_quality_rules": OP5_SQL}
