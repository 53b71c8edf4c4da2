"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bytebpe, language, mixing, neighbours, quality, simhash, urls

QUERIES = {
    f.__name__: f
    for f in (bytebpe.op1_token_counts, bytebpe.op2_token_files, mixing.op3_mixing, language.op4_language, bytebpe.op5_encode, neighbours.op6_neighbours, quality.op7_quality, quality.op8_rules, simhash.op9_simhash, urls.op10_url_filters)
}
ORACLES = {"op3_mixing": mixing.ORACLE}
