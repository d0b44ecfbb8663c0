"""The registered query of each operator, and its SQL where there is one."""

from . import alignment, bit_files, exact_dedup, fingerprints, html_text, lexical, lm_score, near_dedup, packing, pieces, quality, token_counts, toxicity

_MODULES = (packing, exact_dedup, near_dedup, html_text, quality, toxicity, token_counts, pieces, fingerprints, lm_score, bit_files, lexical, alignment)

QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
