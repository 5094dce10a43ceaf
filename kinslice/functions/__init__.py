"""Column functions."""

from .masking import MASKS, mask_characters, mask_email, mask_numbers, null_out
from .sequences import next_values

__all__ = ["MASKS", "mask_characters", "mask_email", "mask_numbers", "next_values", "null_out"]
