"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from tapewright.llm import bpe, decontamination, html, licences, neardup, packing, quality, sharding, spelling, suffixes, topk, toxicity, whitening

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_repeats": suffixes.op2_suffix_repeats,
    "op3_host_suffixes": html.op3_host_suffixes,
    "op4_co_training": quality.op4_co_training,
    "op5_uniform_threshold": topk.op5_uniform_threshold,
    "op6_super_minhash": neardup.op6_super_minhash,
    "op7_licences": licences.op7_licences,
    "op8_gated_network": toxicity.op8_gated_network,
    "op9_templates": decontamination.op9_templates,
    "op10_hilbert_sharding": sharding.op10_hilbert_sharding,
    "op11_cutting_stock": packing.op11_cutting_stock,
    "op12_count_trie": spelling.op12_count_trie,
    "op13_exact_whitening": whitening.op13_exact_whitening,
}

ORACLES: dict[str, str] = {
    "op5_uniform_threshold": topk.SQL,
}
