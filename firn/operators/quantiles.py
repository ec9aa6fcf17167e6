"""Exact quantiles of huge columns without sorting them or gathering them in one task.

An approximate percentile brackets each wanted rank; a count says how many rows lie below and
inside the bracket, and the bracket is narrowed again until so few rows are left inside that
they fit one small array. Counts verify every bracket, so the result is exact.
"""

import math

from pyspark.sql import DataFrame, functions as F

SMALL = 200_000
ACCURACY = 10_000


class _Rank:
    """One wanted order statistic: rank `k` of a column, known to lie in [lo, hi]."""

    def __init__(self, col, k, n):
        self.col, self.k, self.lo, self.hi, self.below, self.inside = col, k, None, None, 0, n

    def key(self):
        return (self.col, self.lo, self.hi)

    def within(self):
        c = F.col(self.col)
        if self.lo is None:
            return c.isNotNull()
        return (c >= F.lit(self.lo)) & (c <= F.lit(self.hi))


def order_statistics(df: DataFrame, ranks: dict, counts: dict, small=SMALL) -> dict:
    """{(column, k): k-th smallest known value, from 0}."""
    wanted = [_Rank(c, k, counts[c]) for c, ks in ranks.items() for k in sorted(set(ks))]
    found = {}
    while wanted:
        ready = [r for r in wanted if r.inside <= small or (r.lo is not None and r.lo == r.hi)]
        for r in ready:
            if r.lo is not None and r.lo == r.hi:
                found[r.col, r.k] = r.lo
        gather = [r for r in ready if (r.col, r.k) not in found]
        if gather:
            brackets = {r.key(): r for r in gather}
            names = {key: f"b{i}" for i, key in enumerate(brackets)}
            arrays = df.agg(*[
                F.array_sort(F.collect_list(F.when(r.within(), F.col(r.col)))).alias(names[key])
                for key, r in brackets.items()
            ]).select(*[
                F.element_at(names[r.key()], r.k - r.below + 1).alias(f"v{i}")
                for i, r in enumerate(gather)
            ]).first()
            for i, r in enumerate(gather):
                found[r.col, r.k] = arrays[i]
        wanted = [r for r in wanted if (r.col, r.k) not in found]
        if wanted:
            _narrow(df, wanted)
    return found


def _narrow(df, wanted):
    margin = 2.0 / ACCURACY
    cuts = []
    for r in wanted:
        p = (r.k - r.below) / max(r.inside - 1, 1)
        ends = [max(0.0, p - margin), min(1.0, p + margin)]
        cuts.append(F.percentile_approx(F.when(r.within(), F.col(r.col)), ends, ACCURACY))
    bounds = df.agg(*[c.alias(f"q{i}") for i, c in enumerate(cuts)]).first()
    tests = []
    for i, r in enumerate(wanted):
        lo, hi = bounds[i]
        c = F.col(r.col)
        tests += [F.count_if(c < F.lit(lo)).alias(f"l{i}"),
                  F.count_if((c >= F.lit(lo)) & (c <= F.lit(hi))).alias(f"i{i}")]
    counted = df.agg(*tests).first()
    for i, r in enumerate(wanted):
        below, inside = counted[f"l{i}"], counted[f"i{i}"]
        lo, hi = bounds[i]
        if below <= r.k < below + inside and inside < r.inside:
            r.lo, r.hi, r.below, r.inside = lo, hi, below, inside
        else:
            _halve(df, r, lo, hi, below, inside)


def _halve(df, r, lo, hi, below, inside):
    """The bracket missed or did not shrink: cut the old one at a value it gave instead."""
    c = F.col(r.col)
    if r.k < below:
        cond, shift = r.within() & (c < F.lit(lo)), r.below
    elif r.k >= below + inside:
        cond, shift = r.within() & (c > F.lit(hi)), below + inside
    else:
        # Same rows as before: split at the median value, its copies forming their own bracket.
        mid = df.agg(F.percentile_approx(F.when(r.within(), c), 0.5, ACCURACY)).first()[0]
        less, same = df.agg(F.count_if(r.within() & (c < F.lit(mid))),
                            F.count_if(c == F.lit(mid))).first()
        if r.k < r.below + less:
            cond, shift = r.within() & (c < F.lit(mid)), r.below
        elif r.k < r.below + less + same:
            r.lo = r.hi = mid
            return
        else:
            cond, shift = r.within() & (c > F.lit(mid)), r.below + less + same
    r.lo, r.hi, n = df.where(cond).agg(F.min(c), F.max(c), F.count(c)).first()
    r.below, r.inside = shift, n


def exact_quantiles(df: DataFrame, probs: dict, small=SMALL, counts=None) -> dict:
    """{column: [values]} with linear interpolation between ranks; None for empty columns.

    `counts` holds the known values of every column, where they were counted before.
    """
    cols = list(probs)
    counts = counts or df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    ranks, spots = {}, {}
    for c, ps in probs.items():
        if counts[c] == 0:
            continue
        spots[c] = [p * (counts[c] - 1) for p in ps]
        ranks[c] = [k for h in spots[c] for k in (math.floor(h), math.ceil(h))]
    found = order_statistics(df.select(*cols), ranks, counts, small)
    out = {}
    for c, ps in probs.items():
        if c not in spots:
            out[c] = [None] * len(ps)
            continue
        values = []
        for h in spots[c]:
            a, b = float(found[c, math.floor(h)]), float(found[c, math.ceil(h)])
            values.append(a + (b - a) * (h - math.floor(h)))
        out[c] = values
    return out


def exact_medians(df: DataFrame, cols, small=SMALL, counts=None) -> dict:
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in cols}, small, counts).items()}
