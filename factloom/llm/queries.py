"""The queries of this package by name, and SQL for those that it can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .decontaminate import OP7_SQL, op7_decontamination
from .hardnegatives import OP13_SQL, op13_hard_negatives
from .hmm import op6_lm_scoring
from .licenses import op1_license_scan
from .linededup import OP8_SQL, op8_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .mixing import OP12_SQL, op12_source_mixing
from .neardup import OP9_SQL, op9_minhash_near_dedup
from .packing import op2_best_fit_packing
from .quality import OP3_SQL, op3_quality_rules
from .secrets import op10_secret_scan
from .tokenids import op4_token_ids

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_ids": op4_token_ids,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mixing": op12_source_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op3_quality_rules": OP3_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_source_mixing": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
