"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontaminate, language, line_templates, main_text, mask_search, minhash, onebit, packing, periodic_runs, sharding, token_files, toxicity, warc

QUERIES = {
    "op1_onebit_nearest": onebit.op1_onebit_nearest,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_host_suffixes": main_text.op3_host_suffixes,
    "op4_harmonic_packing": packing.op4_harmonic_packing,
    "op5_bbit_minhash": minhash.op5_bbit_minhash,
    "op6_winnowing": decontaminate.op6_winnowing,
    "op7_label_propagation_shards": sharding.op7_label_propagation_shards,
    "op8_language_spans": language.op8_language_spans,
    "op9_token_parquet": token_files.op9_token_parquet,
    "op10_line_templates": line_templates.op10_line_templates,
    "op11_mask_search": mask_search.op11_mask_search,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_weak_toxicity": toxicity.op13_weak_toxicity,
}

ORACLES = {
    "op1_onebit_nearest": onebit.ORACLE_SQL,
    "op2_warc_revisits": warc.ORACLE_SQL,
    "op3_host_suffixes": main_text.ORACLE_SQL,
    "op5_bbit_minhash": minhash.ORACLE_SQL,
    "op6_winnowing": decontaminate.ORACLE_SQL,
    "op10_line_templates": line_templates.ORACLE_SQL,
    "op11_mask_search": mask_search.ORACLE_SQL,
}
