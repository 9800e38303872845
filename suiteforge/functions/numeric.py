"""Numeric helpers shared by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(c: Column | str) -> Column:
    """Round to 6 places as ``round(round(x * 1e9) / 1e9 * 1e6) / 1e6``.

    The first step removes last-bit noise from summation order (engines add
    in different orders); scaling before each ``round`` makes the tie decision
    on one IEEE product, which every engine computes identically.
    """
    c = F.col(c) if isinstance(c, str) else c
    nine = F.round(c.cast("double") * F.lit(1e9)) / F.lit(1e9)
    return F.round(nine * F.lit(1e6)) / F.lit(1e6)


def round6_sql(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` in a SQL text to the same scaled form."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6 : k]
        if inner.rstrip().endswith(", 6"):
            expr = round6_sql(inner.rstrip()[:-3])
            out.append(sql[i:j] + f"(round(round(({expr}) * 1e9) / 1e9 * 1e6) / 1e6)")
        else:
            out.append(sql[i : k + 1])
        i = k + 1
