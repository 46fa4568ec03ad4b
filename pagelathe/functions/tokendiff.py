"""Edits between two token sequences, as a vectorised column function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type of a diff.
DIFF = T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))


def token_ops(old: list[str], positions: list[int], new: list[str]) -> list[dict]:
    """``DEL`` and ``INS`` operations in order, at the position of the old token where they begin.

    What is inserted at the end stands at the last old token; into an empty sequence, at 0. A replacement is a ``DEL``
    and then an ``INS``. Equal sequences have no operations.
    """
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        at = positions[min(a, len(old) - 1)] if old else 0
        if a < b:
            out.append({"action": "DEL", "position": at, "tokens": old[a:b]})
        if c < d:
            out.append({"action": "INS", "position": at, "tokens": new[c:d]})
    return out


@F.pandas_udf(DIFF)
def _diff(old: pd.Series, positions: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([token_ops(list(a), list(p), list(b)) for a, p, b in zip(old, positions, new)])


#: Filters on the result must not make the plan run the comparison twice.
_diff = _diff.asNondeterministic()


def token_diff(old: Column, positions: Column, new: Column) -> Column:
    """The diff of ``new`` against ``old`` (``array<string>``), whose tokens stand at ``positions`` (``array<int>``)."""
    return _diff(old, positions, new)
