"""The numbered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import alignment, byte_bpe, chaining, decontaminate, license_scan, line_spread, quality_rules, resampling, sharding, simhash, substrings, target_resampling, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_sharding": sharding.op3_sharding,
        "op4_suffix_dedup": substrings.op4_suffix_dedup,
        "op5_fuzzy_passages": chaining.op5_fuzzy_passages,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_quality_resampling": resampling.op7_quality_resampling,
        "op8_line_spread": line_spread.op8_line_spread,
        "op9_simhash": simhash.op9_simhash,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
        "op12_target_resampling": target_resampling.op12_target_resampling,
        "op13_arc_to_warc": warc.op13_arc_to_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op2_license_scan": license_scan.ORACLE,
        "op8_line_spread": line_spread.ORACLE,
        "op12_target_resampling": target_resampling.ORACLE,
        "op13_arc_to_warc": warc.ORACLE,
    }
