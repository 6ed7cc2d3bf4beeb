"""The fixed-penalty smoother as one Catalyst expression over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATE = "struct<d:double,c:double,e:double,z:double>"


def ws2d_expr(y: Column, w: Column, lam: Column, n: int) -> Column:
    """Smoothed array for arrays of ``n`` steps; no Python worker.

    Forward elimination and back substitution are folds over the index, which
    copy what they have so far at each step: for series of up to about 50 steps.
    """
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "dcez"])
    lam = lam.cast("double")

    def at(acc: Column, back: int) -> Column:
        return F.when(F.size(acc) >= back, F.try_element_at(acc, F.lit(-back))).otherwise(zero)

    def forward(acc: Column, i: Column) -> Column:
        p1, p2 = at(acc, 1), at(acc, 2)
        edge = F.least(i, F.lit(n - 1) - i)
        a = F.when(edge == 0, 1.0).when(edge == 1, 5.0).otherwise(6.0)
        b = F.when((i == 0) | (i == n - 2), -2.0).when(i == n - 1, 0.0).otherwise(-4.0)
        wi = F.element_at(w, i + 1)
        d = wi + a * lam - p1["c"] * p1["c"] * p1["d"] - p2["e"] * p2["e"] * p2["d"]
        c = (b * lam - p1["d"] * p1["c"] * p1["e"]) / d
        e = F.when(i < n - 2, lam / d).otherwise(F.lit(0.0))
        z = wi * F.coalesce(F.element_at(y, i + 1), F.lit(0.0)) - p1["c"] * p1["z"] - p2["e"] * p2["z"]
        row = F.struct(d.alias("d"), F.when(i < n - 1, c).otherwise(F.lit(0.0)).alias("c"), e.alias("e"), z.alias("z"))
        return F.concat(acc, F.array(row))

    steps = F.sequence(F.lit(0), F.lit(n - 1))
    rows = F.aggregate(steps, F.array().cast(f"array<{_STATE}>"), forward)

    def backward(acc: Column, r: Column) -> Column:
        x1 = F.when(F.size(acc) >= 1, F.try_element_at(acc, F.lit(-1))).otherwise(0.0)
        x2 = F.when(F.size(acc) >= 2, F.try_element_at(acc, F.lit(-2))).otherwise(0.0)
        return F.concat(acc, F.array(r["z"] / r["d"] - r["c"] * x1 - r["e"] * x2))

    return F.reverse(F.aggregate(F.reverse(rows), F.array().cast("array<double>"), backward))
