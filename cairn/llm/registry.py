"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import licenses, lm, negatives, parity, pfair, pieces, private, quality, recipes, rules, urls, variants, warc

QUERIES = {f.__name__: f for f in (
    quality.op1_attention_quality, warc.op2_warc, pfair.op3_pfair_mix, private.op4_private_spans, lm.op5_deleted_interpolation,
    parity.op6_parity_join, recipes.op7_chunk_recipes, pieces.op8_sentencepiece,
    rules.op9_quality_rules, licenses.op10_license_scan, urls.op11_wildcard_urls, negatives.op12_spanning_negatives,
    variants.op13_gram_variants)}
SQL = {"op2_warc": warc.OP2_SQL, "op3_pfair_mix": pfair.OP3_SQL, "op7_chunk_recipes": recipes.OP7_SQL,
       "op9_quality_rules": rules.OP9_SQL, "op11_wildcard_urls": urls.OP11_SQL, "op12_spanning_negatives": negatives.OP12_SQL,
       "op13_gram_variants": variants.OP13_SQL}
