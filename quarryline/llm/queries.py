"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import covertree, hamming, jaccard, language, licenses, mixing, packing, pii, secrets, toxicity
from .oracle import ORACLE_SQL  # noqa: F401

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_covertree": covertree.op2_covertree,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_hamming": hamming.op6_hamming,
    "op7_licenses": licenses.op7_licenses,
    "op8_packing": packing.op8_packing,
    "op9_language": language.op9_language,
    "op10_secrets": secrets.op10_secrets,
}
