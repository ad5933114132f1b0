from .derive import ATTEMPT_COLUMNS, RENAMES, derive_attempts, type_and_derive
from .metrics import benefit, contact_sale_rates, count_rows, talk_time
from .numbering import number_attempts
from .reshape import sequence_text, to_long, to_wide
from .shares import category_order, with_exact_share_of_rounded, with_share

__all__ = [
    "ATTEMPT_COLUMNS", "RENAMES", "benefit", "category_order", "contact_sale_rates",
    "count_rows", "derive_attempts", "number_attempts", "sequence_text", "talk_time",
    "to_long", "to_wide", "type_and_derive", "with_exact_share_of_rounded", "with_share",
]
