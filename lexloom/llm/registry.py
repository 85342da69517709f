"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q01_quality_model, q02_packing, q03_embeddings, q04_bpe, q05_simhash, q06_quality, q07_lines, q08_suffix, q09_sharding, q10_secrets, q11_lexicon, q12_hard_negatives, q13_whitening

_MODULES = (q01_quality_model, q02_packing, q03_embeddings, q04_bpe, q05_simhash, q06_quality, q07_lines, q08_suffix, q09_sharding, q10_secrets, q11_lexicon, q12_hard_negatives, q13_whitening)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
