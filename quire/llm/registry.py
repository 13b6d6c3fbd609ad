"""The queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .crf import op10_quality
from .mixing import OP1_SQL, op1_mixing
from .neighbours import OP5_SQL, op5_neighbours
from .ngram_join import op6_ngram_join
from .packing import op8_packing
from .rules import op7_rules
from .sharding import op2_sharding
from .suffix import op9_suffix_dedup
from .tokencount import op4_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_sharding, op3_toxicity, op4_token_counts, op5_neighbours,
        op6_ngram_join, op7_rules, op8_packing, op9_suffix_dedup, op10_quality,
    )
}
SQL = {"op1_mixing": OP1_SQL, "op5_neighbours": OP5_SQL}
