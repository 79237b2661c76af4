"""Validity windows ``[valid_from, valid_to)``, open-ended where ``valid_to`` is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_force(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Filter form: a row without ``valid_from`` is not in force."""
    return (valid_from <= day) & (valid_to.isNull() | (valid_to > day))


def in_force_flag(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Flag form: missing bounds don't limit."""
    return F.coalesce(valid_from <= day, F.lit(True)) & F.coalesce(valid_to > day, F.lit(True))


def searchable(valid_from: Column, valid_to: Column, withdrawn: Column, day: Column, today: Column) -> Column:
    """In force, and not withdrawn if asked for today or later."""
    return in_force(valid_from, valid_to, day) & ((day < today) | ~withdrawn)


def counted_in_force(valid_from: Column, valid_to: Column, withdrawn: Column, day: Column, today: Column) -> Column:
    """Evaluation form: as the flag, and a withdrawn row without an end is out from today on."""
    gone = withdrawn & valid_to.isNull() & (day >= today)
    return in_force_flag(valid_from, valid_to, day) & ~gone
