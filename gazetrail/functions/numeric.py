"""Numbers from raw cells, logarithms and surprisal."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a raw cell; Java would also take "1d" and "0x1p3".
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
WHOLE = r"^\s*([+-]?\d{1,18})\s*$"
FLOOR = 1e-12


def to_num(c: Column) -> Column:
    """A raw cell as a double; what is not a number, NaN among them, is null.

    The cell is named once, so that projections that are folded into each other do not multiply it."""
    return F.regexp_extract(c.cast("string"), NUMBER, 1).try_cast("double")


def to_int(c: Column) -> Column:
    """A raw cell as a long; a fraction is an error, not a rounding.  Plain digits are settled by one look."""
    n = to_num(c)
    plain = F.regexp_extract(c.cast("string"), WHOLE, 1).try_cast("long")
    return F.coalesce(plain, _whole(n, c))


def _whole(n: Column, c: Column) -> Column:
    return F.when(n.isNull() | (n == F.floor(n)), n.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not integral: "), c.cast("string"))).cast("long"))


def safe_log(c: Column) -> Column:
    """Natural logarithm of a number above 0, else null."""
    return F.ln(to_num(c))  # which is null from 0 down


def log_of_double(c: Column) -> Column:
    """The same of a column of doubles, which needs no text; what is infinite or no number is null there too."""
    return F.when(c < float("inf"), F.ln(c))


def safe_logs(df, columns: list[str]) -> dict[str, Column]:
    """The logarithm of each of the columns under log_<column>, by its type."""
    types = dict(df.dtypes)
    return {f"log_{c}": (log_of_double if types[c] == "double" else safe_log)(F.col(c)) for c in columns}


def surprisal_bits(p: Column) -> Column:
    return -F.log2(F.greatest(p, F.lit(FLOOR)))


def nats_to_bits(x: Column) -> Column:
    return x / F.lit(math.log(2))


def log_softmax(scores: Column) -> Column:
    """Of an array of doubles, over all its entries."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(scores, lambda x: x - top - F.ln(total))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")
