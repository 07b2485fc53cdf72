"""The queries of this package by name, and their SQL where SQL can express them."""

from .ann import op6_nearest
from .byte_bpe import op8_byte_bpe
from .exact_topk import OP4_SQL, op4_exact_topk
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .license_scan import op7_license_scan, op7_sql
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import OP2_SQL, op2_packing
from .quality import op10_quality
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import OP5_SQL, op5_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_jaccard_join, op4_exact_topk, op5_suffix_dedup, op6_nearest, op7_license_scan, op8_byte_bpe, op9_substring_dedup, op10_quality)}


def oracle_sql() -> dict[str, str]:
    """Op7's statement holds its model's weights, so it is made when asked for."""
    return {"op1_line_dedup": OP1_SQL, "op2_packing": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_exact_topk": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op7_license_scan": op7_sql(), "op9_substring_dedup": OP9_SQL}
