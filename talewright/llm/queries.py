"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op2_embeddings
from .html import op4_html
from .langid import op1_language
from .oracles import ORACLES
from .licenses import op12_licenses
from .pieces import op6_pieces
from .quality import op5_quality
from .secrets import op9_secrets
from .sharding import op10_sharding
from .simhash import op7_simhash
from .substring import op3_substring_dedup
from .templates import op8_decontamination
from .trie import op13_prefix_trie
from .vector_codes import op11_vector_codes

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_embeddings": op2_embeddings,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_licenses": op12_licenses,
    "op13_prefix_trie": op13_prefix_trie,
}

