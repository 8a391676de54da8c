"""Deterministic masking, PII detection, subsetting and verification for Spark DataFrames."""

from maskframe.context import MaskContext, MaskError
from maskframe.operators.actions import (
    Fake, Hash, HmacHash, JsonMask, NerMask, Null, Passthrough, Pseudonym, RegexMask, Static,
    action_from_dict, rules_from_dict,
)
from maskframe.operators.mask import mask_partitioned, mask_table, mask_tables
from maskframe.session import session_builder
from maskframe.spec import ForeignKey, TableSpec

__all__ = [
    "Fake", "ForeignKey", "Hash", "HmacHash", "JsonMask", "MaskContext", "MaskError", "NerMask",
    "Null", "Passthrough", "Pseudonym", "RegexMask", "Static", "TableSpec", "action_from_dict",
    "mask_partitioned", "mask_table", "mask_tables", "rules_from_dict", "session_builder",
]
