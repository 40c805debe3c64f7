"""The numbered operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from engram.llm import ann as d9
from engram.llm import bpe as d6
from engram.llm import clustering as d11
from engram.llm import decontaminate as d7
from engram.llm import langid as d5
from engram.llm import lm_score as d2
from engram.llm import mixing as d13
from engram.llm import near_dups as d8
from engram.llm import sharding as d1
from engram.llm import substring_dedup as d3
from engram.llm import suffix_dedup as d10
from engram.llm import token_files as d4
from engram.llm import whitening as d12

QUERIES = {
    "op1_sharding": d1.op1_sharding,
    "op2_lm_score": d2.op2_lm_score,
    "op3_substring_dedup": d3.op3_substring_dedup,
    "op4_token_files": d4.op4_token_files,
    "op5_langid": d5.op5_langid,
    "op6_bpe": d6.op6_bpe,
    "op7_decontamination": d7.op7_decontamination,
    "op8_near_dups": d8.op8_near_dups,
    "op9_ann": d9.op9_ann,
    "op10_suffix_dedup": d10.op10_suffix_dedup,
    "op11_clusters": d11.op11_clusters,
    "op12_whitening": d12.op12_whitening,
    "op13_mixing": d13.op13_mixing,
}
SQL = {"op2_lm_score": d2.OP2_SQL, "op3_substring_dedup": d3.OP3_SQL, "op8_near_dups": d8.OP8_SQL, "op10_suffix_dedup": d10.OP10_SQL, "op7_decontamination": d7.OP7_SQL, "op11_clusters": d11.OP11_SQL}
