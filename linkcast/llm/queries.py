"""All registered queries of the text operators with the SQL that checks them."""

from linkcast.llm import (  # noqa: F401
    attribution, decontam, huffman, infill, language, lines, neardup, packing, pii, quality, sharding, toxicity, whitening,
)
from linkcast.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
