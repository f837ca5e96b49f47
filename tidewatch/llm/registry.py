"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe_codec import op2_byte_bpe
from .ctw import op4_ctw_score
from .embedding_dedup import OP9_SQL, op9_hnsw_dedup
from .minhash_dedup import OP10_SQL, op10_bag_minhash
from .packing import op5_nnls_packing
from .secret_scan import op3_secret_scan
from .sharding import op1_jump_sharding
from .topk import OP7_SQL, op7_threshold_topk
from .toxicity import op6_toxicity
from .url_rules import OP8_SQL, op8_url_rules

QUERIES = {f.__name__: f for f in (op1_jump_sharding, op2_byte_bpe, op3_secret_scan, op4_ctw_score, op5_nnls_packing, op6_toxicity, op7_threshold_topk, op8_url_rules, op9_hnsw_dedup, op10_bag_minhash)}
SQL: dict[str, str] = {"op7_threshold_topk": OP7_SQL, "op8_url_rules": OP8_SQL, "op9_hnsw_dedup": OP9_SQL, "op10_bag_minhash": OP10_SQL}
