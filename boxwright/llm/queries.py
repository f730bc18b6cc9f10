"""The queries of this subpackage and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from .bpe import op2_bpe
from .fingerprint import op5_simhash
from .license_scan import OP10_SQL, op10_license_scan
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import op7_mixing
from .ngram_join import OP9_SQL, op9_ngram_join
from .quality import OP4_SQL, op4_quality_rules
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .toxicity import op6_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_ngram_join": OP9_SQL,
    "op10_license_scan": OP10_SQL,
}
