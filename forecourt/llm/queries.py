"""Registered queries of the corpus operators."""

from __future__ import annotations

from forecourt.llm import collocations, decontaminate, lang_id, license_scan, merkle, near_dup, packing, quality, runs, secrets, substring_dedup, toxicity, warc_zip

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_winnow_decontaminate": decontaminate.op4_winnow_decontaminate,
    "op5_lang_ecoc": lang_id.op5_lang_ecoc,
    "op6_merkle_fingerprint": merkle.op6_merkle_fingerprint,
    "op7_toxicity_lexicon": toxicity.op7_toxicity_lexicon,
    "op8_quality_nbsvm": quality.op8_quality_nbsvm,
    "op9_order_minhash": near_dup.op9_order_minhash,
    "op10_secret_grammar": secrets.op10_secret_grammar,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op4_winnow_decontaminate": decontaminate.ORACLE, "op11_substring_dedup": substring_dedup.ORACLE, "op12_phrase_collocations": collocations.ORACLE}
