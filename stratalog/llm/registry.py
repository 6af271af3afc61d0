"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import contamination, fingerprint, jaccard, lines, mixing, quality, secrets, substring, suffix, warc

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_quality": quality.op2_quality,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_suffix": suffix.op4_suffix,
    "op5_secrets": secrets.op5_secrets,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_mix": mixing.op7_mix,
    "op8_lines": lines.op8_lines,
    "op9_contamination": contamination.op9_contamination,
    "op10_warc": warc.op10_warc,
}
SQL = {
    "op1_substring": substring.SQL,
    "op4_suffix": suffix.SQL,
    "op6_jaccard": jaccard.SQL,
    "op7_mix": mixing.SQL,
    "op8_lines": lines.SQL,
    "op10_warc": warc.SQL,
}
