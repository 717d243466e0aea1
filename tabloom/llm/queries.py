"""Queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from .bpe import op12_trie_bpe
from .chat import op5_chat_prefixes
from .jaccard import op10_jaccard_join
from .lm import op6_maxent_scores
from .mixing import op1_mixture_rates
from .packing import op4_packing
from .pii import op7_pii
from .quality import op9_quality_rules
from .repeats import op8_repeated_strings
from .runs import op13_periodic_runs
from .sstable import op3_token_shards
from .variants import op11_spelling_variants
from .vectors import op2_embedding_pivots

QUERIES = {f.__name__: f for f in (op1_mixture_rates, op2_embedding_pivots, op3_token_shards, op4_packing, op5_chat_prefixes, op6_maxent_scores, op7_pii, op8_repeated_strings, op9_quality_rules, op10_jaccard_join, op11_spelling_variants, op12_trie_bpe, op13_periodic_runs)}
ORACLE: dict[str, str] = {}
