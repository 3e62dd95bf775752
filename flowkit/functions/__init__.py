from flowkit.functions.columns import (
    argmax_class, bad_value, bounded_quota, col, euclidean, half_even, hash_unit, inverse_normal,
    one_hot_vector, order_hash, parse_number, percent_text, row_key, safe_label, sanitize_port,
    split_sources, boundary_score,
)

__all__ = [
    "argmax_class", "bad_value", "bounded_quota", "boundary_score", "col", "euclidean",
    "half_even", "hash_unit", "inverse_normal", "one_hot_vector", "order_hash", "parse_number",
    "percent_text", "row_key", "safe_label", "sanitize_port", "split_sources",
]
