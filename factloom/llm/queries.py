"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .edits import op10_token_counts
from .language import op5_language
from .maxent import op9_maxent
from .mixing import OP8_SQL, op8_mixing
from .neighbours import op6_neighbours
from .packing import op1_packing
from .quality import op7_quality
from .repeats import op3_repeats
from .similarity import OP2_SQL, op2_similarity
from .toxicity import op4_toxicity
from .trie import OP13_SQL, op13_prefix_trie
from .warc import OP12_SQL, op12_warc

QUERIES = {q.__name__: q for q in (op1_packing, op2_similarity, op3_repeats, op4_toxicity, op5_language, op6_neighbours, op7_quality, op8_mixing, op9_maxent, op10_token_counts, op11_filter_audit, op12_warc, op13_prefix_trie)}
SQL = {"op2_similarity": OP2_SQL, "op8_mixing": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_warc": OP12_SQL, "op13_prefix_trie": OP13_SQL}
