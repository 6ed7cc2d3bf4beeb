"""Mixing sources to target weights by subset-sum budget fitting (problem 7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoraster.functions.session import bounded_rows, cut
from chronoraster.llm.chunkcode import DEFAULT_DIR
from chronoraster.llm.encode import count_tokens

MAX_SOURCES = 10_000  # rows of the target table
BROADCAST_ROWS = 200_000  # rows of 50 bytes of the plan that are broadcast at most; beyond, the join is salted
SALTS = 32
ROWS_PER_BUCKET = 50_000  # most rows that one rank window holds on average
WORK = 4_000_000_000  # cells times groups that a knapsack window may cost


def source_key(c: Column) -> Column:
    """A source's name regardless of case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))


def _groups(moves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(size, copies) of each move, copies split into powers of two and a rest."""
    out = []
    for size, count in moves:
        step = 1
        while count > 0:
            take = min(step, count)
            out.append((size, take))
            count -= take
            step *= 2
    return out


def _window(adds: list[tuple[int, int]], removes: list[tuple[int, int]], want: int, width: int) -> tuple[int, dict[int, int]]:
    """Largest sum up to ``want`` of moves whose partial sums stay within ``width``, and the moves of each size.

    Bounded-knapsack dynamic programme: for each sum the first group that
    reaches it is kept, which is the way back.
    """
    first = np.full(2 * width + 1, -1, np.int32)
    reach = np.zeros(2 * width + 1, bool)
    reach[width] = True
    groups = [g for pair in zip(_groups(adds), _groups([(-n, c) for n, c in removes])) for g in pair]
    rest = len(groups) // 2
    groups += _groups(adds)[rest:] + _groups([(-n, c) for n, c in removes])[rest:]
    for i, (size, take) in enumerate(groups):
        by = size * take
        if abs(by) > 2 * width:
            continue
        new = np.zeros_like(reach)
        if by > 0:
            new[by:] = reach[:-by]
        else:
            new[:by] = reach[-by:]
        new &= ~reach
        first[new] = i
        reach |= new
        if reach[width + want]:
            break
    best = int(np.flatnonzero(reach[width : width + want + 1])[-1])
    at, out = width + best, {}
    while at != width:
        size, take = groups[first[at]]
        out[size] = out.get(size, 0) + take
        at -= size * take
    return best, out


def fit_budget(lengths: dict[int, int], budget: int, work: int = WORK) -> tuple[dict[int, int], bool]:
    """How many documents of each length to use so that their sum is the largest one not above ``budget``; is that proven?

    Lengths are divided by their common divisor.  A first solution takes them in
    proportion and then from the largest down, so that what is left is less than
    any unused document.  The rest is a bounded knapsack over moves from there:
    one more document of a length, or one fewer.  Let m be the longest length.
    The moves to a best solution with the fewest moves can be put in an order
    that keeps their sum within m of the start; were two of these sums equal,
    the moves between them could be dropped; so there are at most 2 m + 1 moves,
    and a window of m (2 m + 1) about the start, or of all there is to add or
    remove, holds a best solution in any order.  Windows grow from 2 m to that
    one; the first to meet the budget exactly ends the search.  A window beyond
    ``work`` is not tried; then the best found is returned as not proven, and
    stays above the budget less the shortest unused document.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return lengths, True
    if budget <= 0:
        return {}, True
    unit = reduce(gcd, lengths)
    if unit > 1:
        used, proven = fit_budget({n // unit: c for n, c in lengths.items()}, budget // unit, work)
        return {n * unit: c for n, c in used.items()}, proven
    used = {n: c * budget // total for n, c in lengths.items()}
    left = budget - sum(n * c for n, c in used.items())
    for n in sorted(lengths, reverse=True):
        more = min(lengths[n] - used[n], left // n)
        used[n] += more
        left -= more * n
    longest = max(lengths)
    to_add, to_remove = total - budget + left, budget - left
    bound = min(longest * (2 * longest + 1), max(to_add, to_remove))
    proven, width = left == 0, min(bound, 2 * longest)
    best, moves = 0, {}
    while not proven:
        width = max(width, left)
        # a length moves 2 m + 1 times at most, and never beyond the window
        adds = [(n, min(lengths[n] - used[n], 2 * longest + 1, 2 * width // n)) for n in sorted(lengths, reverse=True)]
        removes = [(n, min(used[n], 2 * longest + 1, 2 * width // n)) for n in sorted(lengths)]
        count = sum(c.bit_length() for _, c in adds + removes)
        if moves or width > 2 * longest:
            if 2 * width * count > work:
                break
        got, how = _window(adds, removes, left, width)
        if got > best:
            best, moves = got, how
        proven = best == left or width >= bound
        width = min(bound, 4 * width)
    for size, c in moves.items():
        used[abs(size)] += c if size > 0 else -c
    return {n: c for n, c in used.items() if c}, proven


@dataclass
class Source:
    """A row of the target table with what its documents hold."""

    source: str | None
    key: str | None
    share: float
    cap: int
    docs: int = 0
    tokens: int = 0
    budget: float = 0.0

    @property
    def short(self) -> bool:
        return self.budget > self.cap * self.tokens


@dataclass
class Mixture:
    """sizes: (doc_id, source_key, n_tokens) of listed sources; plan: (source_key, n_tokens, n_docs, repeats, more, proven)."""

    sizes: DataFrame
    plan: DataFrame
    sources: list[Source]


def measure(documents: DataFrame, targets: DataFrame, vocabulary: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> Mixture:
    """Count documents by source and exact token length, and fit each source's budget.

    A source's budget is its share of all listed sources' tokens, each document
    once.  Below its cap, every document is used ``repeats`` times and ``more``
    documents of a length once more, which ``fit_budget`` finds; at the cap every
    document is used that often.  Lengths are counted by partial aggregation and
    fitted by one task per source, which gets one row per length that occurs;
    the driver gets one row per target row.

    Target rows with a null source, share or cap count as share 0 and cap 0.
    Documents of unlisted or null sources are left out.  A source listed twice is an error.
    """
    spark = documents.sparkSession
    listed = bounded_rows(targets.select("source", "target_share", "max_repeat", source_key(F.col("source")).alias("key")), MAX_SOURCES, "the target table")
    sources = [Source(r.source, r.key, float(r.target_share or 0.0), max(0, int(r.max_repeat or 0))) for r in listed]
    keys = [s.key for s in sources if s.key is not None]
    if len(keys) != len(set(keys)):
        raise ValueError("a source is listed twice in the target table")
    wanted = documents.withColumn("__source", source_key(F.col("source")))
    wanted = wanted.where(F.col("__source").isin(keys)) if keys else wanted.where(F.lit(False))
    sizes = cut(count_tokens(wanted, "text", {"doc_id": F.col("doc_id"), "source_key": F.col("__source")}, vocabulary, directory))
    histogram = cut(sizes.groupBy("source_key", "n_tokens").agg(F.count("*").alias("n_docs")))
    held = {r.source_key: r for r in histogram.groupBy("source_key").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")).collect()}
    total = sum(r.tokens for r in held.values())
    for s in sources:
        if s.key in held:
            s.docs, s.tokens = held[s.key].docs, held[s.key].tokens
        s.budget = s.share * total
    budgets = spark.createDataFrame([(s.key, float(s.budget), s.cap, s.tokens) for s in sources if s.tokens], "source_key string, budget double, cap int, tokens bigint")

    def fit(pdf):
        cap, tokens, budget = int(pdf["cap"].iloc[0]), int(pdf["tokens"].iloc[0]), float(pdf["budget"].iloc[0])
        n, c = pdf["n_tokens"].to_numpy(), pdf["n_docs"].to_numpy()
        if budget >= cap * tokens:
            repeats, extra, proven = cap, {}, True
        else:
            repeats = int(budget // tokens)
            extra, proven = fit_budget(dict(zip(n.tolist(), c.tolist())), int(budget - repeats * tokens))
        out = pdf[["source_key", "n_tokens", "n_docs"]].copy()
        out["repeats"], out["more"], out["proven"] = repeats, [extra.get(x, 0) for x in n.tolist()], proven
        return out

    plan = histogram.join(F.broadcast(budgets), "source_key").groupBy("source_key").applyInPandas(fit, "source_key string, n_tokens bigint, n_docs bigint, repeats int, more bigint, proven boolean")
    return Mixture(sizes, cut(plan), sources)


def shares(m: Mixture) -> DataFrame:
    """One row per listed source: wanted and reached tokens and shares, whether it stays short of its
    target at the cap, the tokens its budget is missed by, and whether no selection comes closer from below."""
    used = m.plan.groupBy("source_key").agg(F.sum(F.col("n_tokens") * (F.col("repeats") * F.col("n_docs") + F.col("more"))).alias("chosen"), F.bool_and("proven").alias("proven"))
    by = {r.source_key: r for r in used.collect()}  # one per target row
    chosen = [int(by[s.key].chosen) if s.key in by else 0 for s in m.sources]
    total = sum(chosen)
    rows = [
        (s.source, s.share, s.cap, s.docs, s.tokens, float(s.budget), c, c / total if total else 0.0, s.short, float(s.budget) - c, by[s.key].proven if s.key in by else True)
        for s, c in zip(m.sources, chosen)
    ]
    return m.sizes.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeat int, n_docs bigint, tokens bigint, budget_tokens double, chosen_tokens bigint, reached_share double, short boolean, missed_tokens double, proven boolean")


def select(m: Mixture, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, n_uses): which documents are used, and how often.

    Within a (source, length) the documents with the lowest seeded hash are used
    once more.  Large lengths are split by ranges of that hash, so that only the
    range in which the last used document falls is ranked.  Documents without
    tokens are never used.  A plan of more than ``BROADCAST_ROWS`` rows is joined
    with both sides spread over ``SALTS`` parts of each (source, length).
    """
    spark = m.sizes.sparkSession
    named = spark.createDataFrame([(s.key, s.source) for s in m.sources if s.key is not None], "source_key string, source string")
    want = m.plan.where("n_tokens > 0 and (repeats > 0 or more > 0)").join(F.broadcast(named), "source_key")
    want = want.select("source_key", "n_tokens", "source", "repeats", "more", F.ceil(F.col("n_docs") / ROWS_PER_BUCKET).cast("int").alias("buckets"))
    pos = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    docs, part = m.sizes.withColumn("pos", pos), ["source_key", "n_tokens"]
    if want.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(want), part)
    else:
        want = want.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("salt", (F.col("pos") % SALTS).cast("int")).join(want, [*part, "salt"]).drop("salt")
    docs = docs.withColumn("bucket", (F.col("pos") * F.col("buckets") / F.lit(1 << 40)).cast("int"))
    # rows in earlier buckets of the same (source, length): a small table
    filled = docs.where("more > 0").groupBy(*part, "bucket").agg(F.count("*").alias("here"))
    filled = filled.withColumn("before", F.sum("here").over(Window.partitionBy(*part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    filled = filled.select(*part, "bucket", "here", F.coalesce("before", F.lit(0)).alias("before"))
    docs = docs.join(filled, [*part, "bucket"], "left")
    open_ = F.col("more") - F.col("before")
    whole = docs.where((F.col("more") <= 0) | (open_ <= 0) | (open_ >= F.col("here")))
    whole = whole.withColumn("plus", ((F.col("more") > 0) & (open_ >= F.col("here"))).cast("int"))
    edge = docs.where((F.col("more") > 0) & (open_ > 0) & (open_ < F.col("here")))
    edge = edge.withColumn("rank", F.row_number().over(Window.partitionBy(*part, "bucket").orderBy("pos", "doc_id"))).withColumn("plus", (F.col("rank") <= open_).cast("int")).drop("rank")
    both = whole.unionByName(edge).withColumn("n_uses", F.col("repeats") + F.col("plus"))
    return both.where("n_uses > 0").select("doc_id", "source", "n_tokens", "n_uses")
