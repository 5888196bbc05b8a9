"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tunedata.llm.bpe import op13_bpe_coding
from tunedata.llm.decontaminate import op8_decontaminate
from tunedata.llm.language_id import op2_language_id
from tunedata.llm.line_dedup import op10_line_dedup
from tunedata.llm.lm_scoring import op1_lm_scoring
from tunedata.llm.mixing import op7_mixing
from tunedata.llm.near_dups import op9_near_dups
from tunedata.llm.phrases import ORACLE as PHRASES_ORACLE
from tunedata.llm.phrases import op12_collocations
from tunedata.llm.pii import op3_pii
from tunedata.llm.quality import op4_quality_rules
from tunedata.llm.search import ORACLE as SEARCH_ORACLE
from tunedata.llm.search import op11_lexical_search
from tunedata.llm.token_counts import op5_token_counts
from tunedata.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_dups": op9_near_dups,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_bpe_coding": op13_bpe_coding,
}
ORACLES: dict[str, str] = {"op11_lexical_search": SEARCH_ORACLE, "op12_collocations": PHRASES_ORACLE}
