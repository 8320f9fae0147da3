"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from gatelake.llm.op_exact import OP4_SQL, op4_exact_dedup
from gatelake.llm.op_fingerprint import op9_fingerprint
from gatelake.llm.op_html import op3_html_text
from gatelake.llm.op_language import op5_language_id
from gatelake.llm.op_license import op10_license_scan
from gatelake.llm.op_mixing import op7_mixing
from gatelake.llm.op_near import OP1_SQL, op1_minhash_near_dedup
from gatelake.llm.op_packing import op2_packing
from gatelake.llm.op_pii import op8_pii
from gatelake.llm.op_quality import op6_quality

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_packing, op3_html_text, op4_exact_dedup, op5_language_id, op6_quality, op7_mixing, op8_pii, op9_fingerprint, op10_license_scan)
}

ORACLE_SQL = {"op1_minhash_near_dedup": OP1_SQL, "op4_exact_dedup": OP4_SQL}
