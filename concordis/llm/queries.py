"""Registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from concordis.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from concordis.llm.fingerprint import op9_fingerprint
from concordis.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from concordis.llm.line_dedup import OP6_SQL, op6_line_dedup
from concordis.llm.mixing import op7_mixing
from concordis.llm.packing import op8_packing
from concordis.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from concordis.llm.quality import op1_quality
from concordis.llm.secrets import op4_secrets
from concordis.llm.sharding import op3_sharding
from concordis.llm.simhash import op10_simhash
from concordis.llm.url_rules import op11_url_rules
from concordis.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_fingerprint": op9_fingerprint,
    "op10_simhash": op10_simhash,
    "op11_url_rules": op11_url_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
