"""The queries of the corpus operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from .collisions import op6_embedding_near_dedup
from .debruijn import SQL as DEBRUIJN_SQL
from .debruijn import op2_debruijn_dedup
from .langid import SQL as LANGID_SQL
from .langid import op9_language_id
from .lm import op8_lm_scores
from .maxscore import SQL as MAXSCORE_SQL
from .maxscore import op1_maxscore_topk
from .mixing import op4_mixing
from .packing import op5_best_fit_packing
from .phrases import SQL as PHRASES_SQL
from .phrases import op12_phrase_collocations
from .pii import op3_pii_pseudonyms
from .simhash import op10_simhash_near_dedup
from .spelling import SQL as SPELLING_SQL
from .spelling import op11_spelling_variants
from .suffixes import SQL as SUFFIXES_SQL
from .suffixes import op7_suffix_array_dedup
from .windows import op13_window_packing

QUERIES = {
    "op1_maxscore_topk": op1_maxscore_topk,
    "op2_debruijn_dedup": op2_debruijn_dedup,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_mixing": op4_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_lm_scores": op8_lm_scores,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_window_packing": op13_window_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_maxscore_topk": MAXSCORE_SQL,
    "op2_debruijn_dedup": DEBRUIJN_SQL,
    "op7_suffix_array_dedup": SUFFIXES_SQL,
    "op9_language_id": LANGID_SQL,
    "op11_spelling_variants": SPELLING_SQL,
    "op12_phrase_collocations": PHRASES_SQL,
}
