"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe_codes
from .chat import OP8_SQL, op8_chat_prefix_trees
from .lexical import OP13_SQL, op13_lexical_ranks
from .media import op2_media_columns
from .mixing import op10_mixed_sources
from .pieces import op11_piece_codes
from .pii import op7_private_spans
from .quality import op6_quality_rules
from .sharding import op5_jump_shards
from .simhash import op9_simhash_components
from .suffixes import op3_suffix_dedup
from .trie import OP12_SQL, op12_turn_trie
from .wrappers import op1_page_wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_wrappers": op1_page_wrappers,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_bpe_codes": op4_bpe_codes,
    "op5_jump_shards": op5_jump_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_private_spans": op7_private_spans,
    "op8_chat_prefix_trees": op8_chat_prefix_trees,
    "op9_simhash_components": op9_simhash_components,
    "op10_mixed_sources": op10_mixed_sources,
    "op11_piece_codes": op11_piece_codes,
    "op12_turn_trie": op12_turn_trie,
    "op13_lexical_ranks": op13_lexical_ranks,
}

ORACLES: dict[str, str] = {"op8_chat_prefix_trees": OP8_SQL, "op12_turn_trie": OP12_SQL, "op13_lexical_ranks": OP13_SQL}
