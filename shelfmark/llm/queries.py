"""The queries of this subpackage by name, and SQL for those that SQL can state."""

from __future__ import annotations

from shelfmark.llm.chat_format import OP9_SQL, op9_chat_format
from shelfmark.llm.fano_lm import op5_fano_lm
from shelfmark.llm.flat_graph import OP12_SQL, op12_flat_graph
from shelfmark.llm.fm_substring import op10_fm_substring
from shelfmark.llm.language_bitmask import op2_language_bitmask
from shelfmark.llm.letter_parity import OP11_SQL, op11_letter_parity
from shelfmark.llm.line_quality import op3_line_quality
from shelfmark.llm.minmax_dedup import op4_minmax_dedup
from shelfmark.llm.piece_sampling import op1_piece_sampling
from shelfmark.llm.pruned_graph import op8_pruned_graph
from shelfmark.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from shelfmark.llm.source_mix import op7_source_mix
from shelfmark.llm.span_crf import op6_span_crf

QUERIES = {
    "op1_piece_sampling": op1_piece_sampling,
    "op2_language_bitmask": op2_language_bitmask,
    "op3_line_quality": op3_line_quality,
    "op4_minmax_dedup": op4_minmax_dedup,
    "op5_fano_lm": op5_fano_lm,
    "op6_span_crf": op6_span_crf,
    "op7_source_mix": op7_source_mix,
    "op8_pruned_graph": op8_pruned_graph,
    "op9_chat_format": op9_chat_format,
    "op10_fm_substring": op10_fm_substring,
    "op11_letter_parity": op11_letter_parity,
    "op12_flat_graph": op12_flat_graph,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {"op9_chat_format": OP9_SQL, "op11_letter_parity": OP11_SQL, "op12_flat_graph": OP12_SQL, "op13_prefix_trie": OP13_SQL}
