"""All queries of this subpackage, in one place."""

from maskframe.llm import (  # noqa: F401
    bpe, chat, collocations, decontaminate, html_text, licenses, line_dedup, quality, repeats, shards, simhash, spelling,
    wordpiece,
)
from maskframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
