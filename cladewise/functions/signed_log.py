"""Numbers kept as a sign and the log of their size, for values that a double can't hold: struct columns (sign, log).

Zero has sign 0 and a null log. A null number gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathx import logadd, logsub


def pack(sign: Column, log: Column) -> Column:
    sign = sign.cast("int")
    return F.struct(sign.alias("sign"), F.when(sign != 0, log.cast("double")).alias("log"))


def of(x: Column) -> Column:
    return F.when(x.isNotNull(), pack(F.signum(x), F.log(F.abs(x))))


def value(a: Column) -> Column:
    return F.when(a["sign"] == 0, F.lit(0.0)).otherwise(a["sign"] * F.exp(a["log"]))


def negative(a: Column) -> Column:
    return pack(-a["sign"], a["log"])


def add(a: Column, b: Column) -> Column:
    """Equal signs add up; else the smaller size is taken from the larger one."""
    apart = F.when(a["log"] > b["log"], pack(a["sign"], logsub(a["log"], b["log"]))).when(a["log"] < b["log"], pack(b["sign"], logsub(b["log"], a["log"]))).otherwise(pack(F.lit(0), a["log"]))
    both = F.when(a["sign"] == b["sign"], pack(a["sign"], logadd(a["log"], b["log"]))).otherwise(apart)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a["sign"] == 0, b).when(b["sign"] == 0, a).otherwise(both)


def subtract(a: Column, b: Column) -> Column:
    return add(a, negative(b))


def multiply(a: Column, b: Column) -> Column:
    return pack(a["sign"] * b["sign"], a["log"] + b["log"])


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.when(b["sign"] != 0, pack(a["sign"] * b["sign"], a["log"] - b["log"]))


def power(a: Column, n: int) -> Column:
    return pack(F.lit(1), F.lit(0.0)) if n == 0 else pack(a["sign"] if n % 2 else F.abs(a["sign"]), a["log"] * n)


def less(a: Column, b: Column) -> Column:
    same = F.when(a["sign"] > 0, a["log"] < b["log"]).when(a["sign"] < 0, a["log"] > b["log"]).otherwise(F.lit(False))
    return F.when(a["sign"] != b["sign"], a["sign"] < b["sign"]).otherwise(same)
