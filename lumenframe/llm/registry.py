"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from lumenframe.llm.bpe import op2_bpe
from lumenframe.llm.fingerprints import op1_fingerprints
from lumenframe.llm.langid import op4_langid
from lumenframe.llm.line_dedup import op5_line_dedup
from lumenframe.llm.mixing import OP6_SQL, op6_mixing
from lumenframe.llm.near_dedup import OP9_SQL, op9_near_dedup
from lumenframe.llm.suffix_dedup import op8_suffix_dedup
from lumenframe.llm.topk import OP10_SQL, op10_topk
from lumenframe.llm.toxicity import op7_toxicity
from lumenframe.llm.warc import OP3_SQL, op3_warc

QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_bpe": op2_bpe, "op3_warc": op3_warc, "op4_langid": op4_langid, "op5_line_dedup": op5_line_dedup, "op6_mixing": op6_mixing, "op7_toxicity": op7_toxicity, "op8_suffix_dedup": op8_suffix_dedup, "op9_near_dedup": op9_near_dedup, "op10_topk": op10_topk}
ORACLES = {"op3_warc": OP3_SQL, "op6_mixing": OP6_SQL, "op9_near_dedup": OP9_SQL, "op10_topk": OP10_SQL}
