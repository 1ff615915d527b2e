"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_OPS = {
    "op1_line_dedup": ("linedup", "op1_line_dedup"),
    "op2_langid": ("langid", "op2_langid"),
    "op3_secret_scan": ("secrets", "op3_secret_scan"),
    "op4_neardup": ("neardup", "op4_neardup"),
    "op5_toxicity": ("toxicity", "op5_toxicity"),
    "op6_personal_data": ("pii", "op6_personal_data"),
    "op7_license_scan": ("licenses", "op7_license_scan"),
    "op8_decontamination": ("decontam", "op8_decontamination"),
    "op9_bestfit_packing": ("packing", "op9_bestfit_packing"),
    "op10_exact_topk": ("topk", "op10_exact_topk"),
    "op11_vector_codes": ("veccodes", "op11_vector_codes"),
    "op12_merkle_manifest": ("merkle", "op12_merkle_manifest"),
    "op13_chat_format": ("chat", "op13_chat_format"),
}


def queries() -> dict:
    found = {name: getattr(import_module(f"hodoscope.llm.{mod}"), fn) for name, (mod, fn) in _OPS.items()}
    return found


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (mod, _) in _OPS.items():
        sql = getattr(import_module(f"hodoscope.llm.{mod}"), "ORACLE", None)
        if sql:
            out[name] = sql
    return out
