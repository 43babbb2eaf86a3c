"""Queries opN_* and their SQL where SQL can express them."""

from __future__ import annotations

from . import filter_audit, licenses, mixing
from .bpe import op3_byte_bpe
from .filter_audit import op13_filter_audit
from .langid import op9_language_id
from .licenses import op11_license_scan
from .minhash import op1_minhash_near_dedup
from .mixing import op5_mix_sources
from .pii import op6_private_data
from .quality import op4_quality_rules
from .substrings import op8_substring_dedup
from .urls import op10_url_filter
from .warc import op2_warc
from .whitening import op12_whitening
from .winnowing import op7_winnowing

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_mix_sources": op5_mix_sources,
    "op6_private_data": op6_private_data,
    "op7_winnowing": op7_winnowing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op5_mix_sources": mixing.SQL, "op11_license_scan": licenses.sql(), "op13_filter_audit": filter_audit.SQL}
