"""Exact k-nearest-neighbour filling without comparing every pair of rows.

Distance is Euclidean over the numbers both rows know, scaled by the share known. All columns
are filled in the same passes: a row takes part once per column, as a donor of its value or as
a gap. The donors of a column lie in a K-d tree. Its top is fitted on a sample and cuts them
into cells; a task builds the rest of the tree of a cell (`kdtree`). A gap first searches its own
cell. The k-th distance found there bounds the other cells it has to visit.

Copies are merged first: equal gap rows search once, and of donors at the same place only the
k smallest values can matter, because ties go to the smaller value.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from firn.functions.scalars import numeric_columns
from firn.operators.kdtree import Nearest, Tree, scales
from firn.operators.series import join_same
from firn.session import materialize

#: Donors of a cell, about; cells of a tree at most, beyond which cells grow; sampled donors per cell.
CELL, CELLS, FIT = 8_000, 16_384, 32
#: Gaps that search a cell in one task; more are dealt to several tasks, each with the cell's donors.
GAPS = 200_000
_BATCH = 2048


def _places(df: DataFrame, cols, fill) -> DataFrame:
    """(t, x, v): every row once per column to fill, `x` its other numbers; NaN stands for unknown."""
    number = [F.coalesce(F.col(c), F.lit(float("nan"))) for c in cols]
    unknown = F.lit(float("nan"))
    one = [F.struct(F.lit(t).alias("t"), F.array(*[unknown if c == cols[t] else n for c, n in zip(cols, number)]).alias("x"),
                    F.col(cols[t]).alias("v")) for t in fill]
    return df.select(F.explode(F.array(*one)).alias("p")).select("p.*")


def _donors(places: DataFrame, k) -> DataFrame:
    """(t, x, v, m): the distinct donors and how many rows they stand for."""
    merged = places.where("v IS NOT NULL").groupBy("t", "x", "v").agg(F.count("*").alias("m"))
    first = W.partitionBy("t", "x").orderBy("v")
    return merged.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k).drop("i")


def _tops(donors: DataFrame) -> dict:
    """{t: Tree} whose leaves are the cells, fitted on about FIT donors per cell."""
    sizes = {r.t: r["count"] for r in donors.groupBy("t").count().collect()}
    wanted = {t: max(1, min(CELLS, n // CELL)) for t, n in sizes.items()}
    share = reduce(lambda e, t: e.when(F.col("t") == t, FIT * wanted[t] / sizes[t]), sizes, F.when(F.lit(False), 0.0))
    # at least one donor per column, so that each has a tree
    one = donors.groupBy("t").agg(F.min("x").alias("x"))
    picked = donors.where(F.pmod(F.xxhash64("t", "x", "v"), F.lit(1 << 30)) < share * (1 << 30)).select("t", "x")
    rows = {}
    for r in picked.unionByName(one).collect():
        rows.setdefault(r.t, []).append(r.x)
    return {t: Tree(np.array(sorted(x), float), FIT if wanted[t] > 1 else len(x)) for t, x in rows.items()}


def _matrix(column):
    """A list column as a matrix; all lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _located(df: DataFrame, tops: dict, own: bool) -> DataFrame:
    """Add `cell`: of a donor where it belongs (`own`), of a gap where it searches first."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, cell long"
    names = [*df.columns, "cell"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                t, x = b.column("t").to_numpy(), _matrix(b.column("x"))
                cell = np.zeros(len(t), np.int64)
                for i in np.unique(t).tolist():
                    rows = t == i
                    cell[rows] = tops[i].place(x[rows]) if own else tops[i].home(x[rows])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=names)

    return df.mapInArrow(run, schema)


def _bounded(tops: dict, donors: DataFrame, width) -> dict:
    """The trees with the boxes their cells really fill; a column some donor does not know sets no bound."""
    known = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    box = donors.groupBy("t", "cell").agg(
        F.count("*").alias("n"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(known)],
        *[F.min(v).alias(f"lo{i}") for i, v in enumerate(known)], *[F.max(v).alias(f"hi{i}") for i, v in enumerate(known)])
    boxes = {(r.t, r.cell): r for r in box.collect()}
    for t, tree in tops.items():
        leaves = np.flatnonzero(tree.column < 0)
        low, high = np.full((len(leaves), width), np.inf), np.full((len(leaves), width), -np.inf)
        for j, at in enumerate(leaves.tolist()):
            r = boxes.get((t, at))
            for i in range(width if r else 0):
                full = r[f"n{i}"] == r.n
                low[j, i], high[j, i] = (r[f"lo{i}"], r[f"hi{i}"]) if full else (-np.inf, np.inf)
        tree.bound_by(low, high)
    return tops


def _visits(gaps: DataFrame, tops: dict, width) -> DataFrame:
    """(t, cell, key, x, bound) for the cells within the bound of a gap, without its own."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, _BATCH):
                p = b.slice(lo, _BATCH)
                t, x = p.column("t").to_numpy(), _matrix(p.column("x"))
                bound, own = p.column("bound").to_numpy(zero_copy_only=False), p.column("cell").to_numpy()
                for i in np.unique(t).tolist():
                    rows = np.flatnonzero(t == i)
                    who, cell, _ = tops[i].reach(x[rows], scales(x[rows], width), bound[rows])
                    who = rows[who]
                    other = cell != own[who]
                    who, cell = who[other], cell[other]
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [p.column("t").take(at), pa.array(cell), p.column("key").take(at), p.column("x").take(at), pa.array(bound[who])],
                        names=["t", "cell", "key", "x", "bound"])

    return gaps.select("t", "cell", "key", "x", "bound").mapInArrow(run, "t int, cell long, key long, x array<double>, bound double")


def _searched(donors: DataFrame, gaps: DataFrame, k, width) -> DataFrame:
    """(key, d, v, m): of every gap (t, cell, key, x, bound) the nearest donors of that cell."""
    crowd = gaps.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > GAPS)
    crowd = crowd.select("t", "cell", F.ceil(F.col("n") / GAPS).cast("int").alias("parts"))
    spread = donors.join(F.broadcast(crowd), ["t", "cell"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = gaps.join(F.broadcast(crowd), ["t", "cell"], "left").withColumn(
        "part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int"))
    none, head = F.lit(None), ["t", "cell", "part"]
    both = spread.select(*head, F.lit(0).alias("kind"), none.cast("long").alias("key"), "x", "v", "m", none.cast("double").alias("bound")).unionByName(
        dealt.select(*head, F.lit(1).alias("kind"), "key", "x", none.cast("double").alias("v"), none.cast("long").alias("m"), "bound"))

    def run(batches):
        at, parts, near = None, [], None
        for b in batches:
            t, cell, part, kind = (b.column(i).to_numpy() for i in range(4))
            change = np.flatnonzero((np.diff(t) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                here = (int(t[lo]), int(cell[lo]), int(part[lo]))
                if here != at:
                    at, parts, near = here, [], None
                p = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    parts.append((_matrix(p.column("x")), p.column("v").to_numpy(zero_copy_only=False), p.column("m").to_numpy(zero_copy_only=False).astype(np.int64)))
                    continue
                if not parts:  # a cell that only the sample filled
                    continue
                near = near or Nearest(*(np.concatenate(c) for c in zip(*parts)), k, width)
                for i in range(0, hi - lo, _BATCH):
                    q = p.slice(i, _BATCH)
                    row, d, v, m = near.search(_matrix(q.column("x")), q.column("bound").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([q.column("key").take(pa.array(row)), pa.array(d), pa.array(v), pa.array(m)], names=["key", "d", "v", "m"])

    # a number of its own keeps small but busy cells from being put together in one task
    tasks = int(donors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(tasks, *head).sortWithinPartitions(*head, "kind")
    return rows.mapInArrow(run, "key long, d double, v double, m long")


def neighbour_means(df: DataFrame, cols, fill, k=5) -> DataFrame:
    """(t, x, fill): for every distinct gap the mean of its k nearest donors.

    `t` counts the columns, `x` holds the other numbers of the row. `fill` is null where no donor
    shares a known column.
    """
    width = len(cols)
    places = _places(df, cols, [cols.index(c) for c in fill])
    donors = materialize(_donors(places, k))
    # The short key is written with the rows, so it stays the same whenever they are read again.
    gaps = materialize(places.where("v IS NULL").select("t", "x").distinct().withColumn("key", F.monotonically_increasing_id()))
    tops = _tops(donors)
    if not tops:
        return gaps.select("t", "x", F.lit(None).cast("double").alias("fill"))
    donors = materialize(_located(donors, tops, own=True))
    tops = _bounded(tops, donors, width)
    open_ = F.exists("x", lambda e: ~F.isnan(e)) & F.col("t").isin(*tops)
    searching = materialize(_located(gaps.where(open_), tops, own=False))
    near = materialize(_searched(donors, searching.withColumn("bound", F.lit(float("inf"))), k, width))
    last = near.groupBy("key").agg(F.sum("m").alias("n"), F.max("d").alias("d"))
    bound = F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")))
    further = searching.join(last, "key", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
    further = materialize(_visits(further, tops, width))
    near = near.unionByName(_searched(donors, further, k, width))
    order = W.partitionBy("key").orderBy("d", "v")
    best = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    before = F.coalesce(F.sum("m").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.least(F.col("m"), k - before), F.lit(0))
    taken = best.withColumn("w", share).groupBy("key").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("fill"))
    return gaps.join(taken, "key", "left").select("t", "x", "fill")


def fill_knn(df: DataFrame, cols=None, k=5, fill=None) -> DataFrame:
    """Fill every gap with the mean of the k nearest rows that know the value.

    `cols` are the columns that make up the distance, `fill` those to fill (all by default).
    Distances always use the values from before the filling. A gap that shares no known column
    with any donor gets the column's mean; a column without any value stays unknown.
    """
    cols = list(cols or numeric_columns(df))
    fill = list(fill or cols)
    q = lambda c: F.col(f"`{c}`")
    numbers = materialize(df.select(*[q(c).cast("double").alias(c) for c in cols]))
    facts = numbers.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(fill)], *[F.count(F.when(q(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(fill)]).first()
    gappy = [c for i, c in enumerate(fill) if facts[f"n{i}"]]
    if not gappy:
        return df
    means = materialize(neighbour_means(numbers.toDF(*[f"c{i}" for i in range(len(cols))]), [f"c{i}" for i in range(len(cols))], [f"c{cols.index(c)}" for c in gappy], k))
    any_gap = reduce(lambda a, b: a | b, [q(c).isNull() for c in gappy])
    whole, out = df.where(~any_gap), df.where(any_gap)
    nan = F.lit(float("nan"))
    place = lambda c: F.when(q(c).isNull(), F.array(*[nan if o == c else F.coalesce(q(o).cast("double"), nan) for o in cols]))
    out = out.withColumns({f"__x{i}": place(c) for i, c in enumerate(gappy)})
    for i, c in enumerate(gappy):
        own = means.where(F.col("t") == cols.index(c)).select(F.col("x").alias(f"__x{i}"), F.col("fill").alias("__fill"))
        out = out.join(own, f"__x{i}", "left")
        out = out.withColumn(c, F.coalesce(q(c).cast("double"), "__fill", F.lit(facts[f"m{fill.index(c)}"]))).drop("__fill")
    return whole.select(*[q(c).cast(out.schema[c].dataType).alias(c) for c in df.columns]).unionByName(out.select(*[q(c) for c in df.columns]))
