"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from fieldloom.llm import backoff, collocations, factor_machine, jaccard_join, license_rules, line_rules, mixing, packing, simhash, url_templates, vector_search, warc

QUERIES = {
    "op8_path_templates": url_templates.op8_path_templates,
    "op3_posting_lists": vector_search.op3_posting_lists,
    "op4_warc": warc.op4_warc,
    "op6_factor_machine": factor_machine.op6_factor_machine,
    "op10_backoff": backoff.op10_backoff,
    "op1_prefix_join": jaccard_join.op1_prefix_join,
    "op2_best_fit": packing.op2_best_fit,
    "op9_license_rules": license_rules.op9_license_rules,
    "op5_golden_mix": mixing.op5_golden_mix,
    "op7_line_rules": line_rules.op7_line_rules,
    "op11_prefix_growth": collocations.op11_prefix_growth,
    "op12_byte_index": simhash.op12_byte_index,
}
ORACLES = {
    "op8_path_templates": url_templates.ORACLE,
    "op10_backoff": backoff.ORACLE,
    "op4_warc": warc.ORACLE,
    "op1_prefix_join": jaccard_join.ORACLE,
    "op5_golden_mix": mixing.ORACLE,
    "op7_line_rules": line_rules.ORACLE,
    "op11_prefix_growth": collocations.ORACLE,
}
