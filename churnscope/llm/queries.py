"""The operators' queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from churnscope.llm.decontamination import ORACLE as OP3_SQL, op3_positional_index, proximity_matches
from churnscope.llm.language import op8_string_kernels
from churnscope.llm.lines import op7_line_hashing
from churnscope.llm.mixing import op2_rake_mix
from churnscope.llm.near_duplicates import op10_bag_min_hash
from churnscope.llm.pages import op6_site_templates
from churnscope.llm.private import op13_boosted_candidates
from churnscope.llm.quality import op5_co_training
from churnscope.llm.resampling import ORACLE as OP12_SQL, op12_split_resampling
from churnscope.llm.runs import op11_suffix_automaton_runs
from churnscope.llm.scoring import op4_masked_pseudo_likelihood
from churnscope.llm.sharding import op9_histogram_sort
from churnscope.llm.sketches import op1_paragraph_sketches

QUERIES = {f.__name__: f for f in (
    op1_paragraph_sketches, op2_rake_mix, op3_positional_index, op4_masked_pseudo_likelihood, op5_co_training,
    op6_site_templates, op7_line_hashing, op8_string_kernels, op9_histogram_sort, op10_bag_min_hash,
    op11_suffix_automaton_runs, op12_split_resampling, op13_boosted_candidates, proximity_matches)}

ORACLE_SQL = {"op3_positional_index": OP3_SQL, "op12_split_resampling": OP12_SQL}
