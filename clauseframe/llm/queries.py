"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from clauseframe.llm.decontaminate import op10_decontamination
from clauseframe.llm.gif_media import op7_gif_media
from clauseframe.llm.language_id import op5_language_id
from clauseframe.llm.main_text import op2_main_text
from clauseframe.llm.ngram_join import op8_ngram_join
from clauseframe.llm.packing import op1_packing
from clauseframe.llm.periodic_runs import op11_periodic_runs
from clauseframe.llm.prefix_trie import SQL as TRIE_SQL
from clauseframe.llm.prefix_trie import op13_prefix_trie
from clauseframe.llm.sharding import SQL as SHARDING_SQL
from clauseframe.llm.sharding import op4_sharding
from clauseframe.llm.token_counts import op9_token_counts
from clauseframe.llm.token_shards import op3_token_shards
from clauseframe.llm.toxicity import op6_toxicity
from clauseframe.llm.warc import SQL as WARC_SQL
from clauseframe.llm.warc import op12_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_main_text": op2_main_text,
    "op3_token_shards": op3_token_shards,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_gif_media": op7_gif_media,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": SHARDING_SQL,
    "op12_warc": WARC_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
