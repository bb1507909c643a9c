"""Column expressions: activations, NULL/NaN rule, integer truncation, SQL text."""

from veloscore.functions.activations import ACTIVATIONS, activation
from veloscore.functions.columns import any_missing, first_element, is_missing, to_int

__all__ = ["ACTIVATIONS", "activation", "any_missing", "first_element", "is_missing", "to_int"]
