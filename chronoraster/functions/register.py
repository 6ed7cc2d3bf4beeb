"""Kernels as SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def register(spark: SparkSession) -> list[str]:
    """Register ``ws2d(y, w, log10_s)``, ``ws2dp(y, w, log10_s, p)``, ``lag1corr(y, w)`` and ``posix_cksum(text)``."""
    import numpy as np

    from chronoraster.functions import whittaker as k

    def each(f, *cols):
        """``f`` on matrices of equally long series (and equal further arguments but the penalty), one call a group."""
        out, groups = [None] * len(cols[0]), {}
        for i, r in enumerate(zip(*cols)):
            if not any(c is None or c is pd.NA or isinstance(c, float) and np.isnan(c) for c in r):
                groups.setdefault((len(r[0]), len(r[1]), *r[3:]), []).append(i)
        for key, rows in groups.items():
            y, w = (np.nan_to_num(np.stack([np.asarray(c[i], float) for i in rows], axis=1)) for c in cols[:2])
            lam = (10.0 ** np.array([cols[2][i] for i in rows], float),) if len(cols) > 2 else ()
            for i, v in zip(rows, f(y, w, *lam, *key[2:])):
                out[i] = v
        return pd.Series(out)

    @pandas_udf("array<double>")
    def ws2d(y: pd.Series, w: pd.Series, s: pd.Series) -> pd.Series:
        return each(lambda a, b, lam: k.ws2d(a, lam, b).T.tolist(), y, w, s)

    @pandas_udf("array<double>")
    def ws2dp(y: pd.Series, w: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return each(lambda a, b, lam, q: k.ws2dp(a, lam, b, q).T.tolist(), y, w, s, p)

    @pandas_udf("double")
    def lag1corr(y: pd.Series, w: pd.Series) -> pd.Series:
        return each(lambda a, b: k.lag1corr(a, b > 0).tolist(), y, w)

    @pandas_udf("bigint")
    def posix_cksum(t: pd.Series) -> pd.Series:
        from chronoraster.sources.files import posix_cksum as f

        return t.map(lambda v: None if v is None else f(v.encode() if isinstance(v, str) else bytes(v)))

    found = {"ws2d": ws2d, "ws2dp": ws2dp, "lag1corr": lag1corr, "posix_cksum": posix_cksum}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
