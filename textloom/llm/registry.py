"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from textloom.llm.bpe import op11_merge_round_bpe
from textloom.llm.collocations import OP12_SQL, op12_de_bruijn_collocations
from textloom.llm.decontaminate import op7_fm_index_decontamination
from textloom.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from textloom.llm.licenses import op4_diagonal_license_scan
from textloom.llm.main_text import op3_tree_main_text
from textloom.llm.packing import op6_best_fit_packing
from textloom.llm.pseudonyms import op2_feistel_pseudonyms
from textloom.llm.quality_classifier import op10_factorisation_machine_quality
from textloom.llm.quality_rules import op8_mcd_quality_rules
from textloom.llm.sharding import op9_sampled_splitter_shards
from textloom.llm.simhash import op1_simhash_near_dedup
from textloom.llm.substrings import op5_fixed_block_substring_dedup

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_tree_main_text": op3_tree_main_text,
    "op4_diagonal_license_scan": op4_diagonal_license_scan,
    "op5_fixed_block_substring_dedup": op5_fixed_block_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_fm_index_decontamination": op7_fm_index_decontamination,
    "op8_mcd_quality_rules": op8_mcd_quality_rules,
    "op9_sampled_splitter_shards": op9_sampled_splitter_shards,
    "op10_factorisation_machine_quality": op10_factorisation_machine_quality,
    "op11_merge_round_bpe": op11_merge_round_bpe,
    "op12_de_bruijn_collocations": op12_de_bruijn_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {"op12_de_bruijn_collocations": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
