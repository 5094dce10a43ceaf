"""Masks for sensitive values, as native column expressions.

Replacement characters come from a keyed hash of the value and the character's place, so the same
value is masked alike everywhere, which keeps joins on masked columns; ``seed`` changes them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pick(alphabet: str, value: Column, place: Column, seed: int) -> Column:
    n = F.pmod(F.xxhash64(value, place, F.lit(seed)), F.lit(len(alphabet))).cast("int")
    return F.substring(F.lit(alphabet), n + 1, F.lit(1))


def _replaced(column: Column, pattern: str, alphabet: str, seed: int) -> Column:
    value = column.cast("string")
    marked = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(pattern), _pick(alphabet, value, i, seed)).otherwise(c))
    return F.array_join(marked, "")


def null_out(column: Column, seed: int = 0) -> Column:
    return F.when(F.lit(False), column)


def mask_numbers(column: Column, seed: int = 0) -> Column:
    """Each digit becomes some digit; the rest and nulls stay."""
    return _replaced(column, r"^\d$", "0123456789", seed)


def mask_characters(column: Column, seed: int = 0) -> Column:
    """Each letter becomes some letter of either case; the rest and nulls stay."""
    return _replaced(column, r"^\p{L}$", _LETTERS, seed)


def mask_email(column: Column, seed: int = 0) -> Column:
    """Another user at the same domain, the text between the first and second ``@``; without ``@``
    another address altogether; nulls stay."""
    value = column.cast("string")
    user = F.concat(F.lit("user_"), F.lower(F.hex(F.xxhash64(value, F.lit(seed)))))
    parts = F.split(value, "@", -1)
    domain = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("example.com")
    return F.when(value.isNotNull(), F.concat(user, F.lit("@"), domain))


MASKS: dict[str, Callable[..., Column]] = {
    "null_out": null_out, "mask_numbers": mask_numbers, "mask_characters": mask_characters, "mask_email": mask_email,
}
