"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from watchgrid.llm import ann, caps, html, jaccard, lm, mixing, pieces, pii, quality, warc

QUERIES = {
    "op1_deleted_interpolation": lm.op1,
    "op2_rp_forest": ann.op2,
    "op3_mixture_split_tree": mixing.op3,
    "op4_pii_boosting": pii.op4,
    "op5_ngram_jaccard": jaccard.op5,
    "op6_suffix_array_pieces": pieces.op6,
    "op7_weak_labels": quality.op7,
    "op8_warc_zip": warc.op8,
    "op9_spherical_caps": caps.op9,
    "op10_site_style_tree": html.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": jaccard.SQL,
    "op8_warc_zip": warc.SQL,
    "op9_spherical_caps": caps.SQL,
}
