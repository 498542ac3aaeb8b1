"""Expressions that are computed once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(v)` with `value` computed once and bound to a lambda variable.

    Catalyst may inline a projected expression into each lambda that mentions it, which
    would compute it again for each element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
