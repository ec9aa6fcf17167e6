"""Second-order boosted trees on histograms, with a learned direction for unknown inputs.

Two passes read the rows: one sums up every input by values evenly spaced among its rows, from which the cuts
come, one bins the rows and writes blocks, whose columns are the bytes of numpy arrays, so that later
passes hand few long values to Python instead of many short ones. Every level of a tree is one pass: tasks add up gradients
and weights per node, column and bin, Spark sums these, and the driver picks the splits from
numbers whose size depends on the tree alone. Sums of the two sides give the leaf values, so
the last level needs no pass. Rows keep their place in the forest by being walked down the trees
grown since the last write.

Every value of a category column is a 0/1 input of its own, as if it were one-hot encoded, but no such
input is ever made: a block holds its values once and a number per row, Spark sums per node and value and
keeps the best value of each node, so work grows with the rows and not with rows times values.
"""

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.models.regression import Boosting, Forecaster, normalise, quoted
from firn.operators.aggregates import error_metrics
from firn.session import forget, materialize

#: Trees after which the rows are written again with their predictions.
KEEP_EVERY = 10
#: Rows of a block, about.
BLOCK = 50_000
#: Points of a summary per bin, summaries that are joined at a time, and groups that the tasks' summaries are joined in first.
POINTS, FAN, GROUPS = 40, 8, 32
NODE = ("round int, node int, feature string, cut double, unknown_left boolean, left int, right int, value double, gain double, cover double, "
        "category string")


class Tree:
    """Nodes as arrays; `feature` is -1 in leaves, `cut` counts bins and `limit` is its value.

    Category columns are numbered after the inputs; rows with the value `category` go right there, all others left.
    """

    def __init__(self, rate=1.0):
        self.rate = rate
        self.category = [None]
        self.feature, self.cut, self.limit, self.unknown_left = [-1], [0], [0.0], [True]
        self.left, self.right, self.value, self.gain, self.cover = [0], [0], [0.0], [0.0], [0.0]

    def split(self, at, feature, cut, limit, unknown_left, gain, category=None):
        self.category += [None, None]
        self.category[at] = category
        for column, new in ((self.feature, -1), (self.cut, 0), (self.limit, 0.0), (self.unknown_left, True), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
            column += [new, new]
        n = len(self.feature)
        self.feature[at], self.cut[at], self.limit[at], self.unknown_left[at], self.gain[at] = feature, cut, limit, unknown_left, gain
        self.left[at], self.right[at] = n - 2, n - 1
        return n - 2, n - 1

    def walk(self, x, cuts, unknown, same=None):
        """The node each row ends in, for the columns `x`; `unknown(values)` tells which values are not known.

        `same(k, value)` tells which rows have that value in category column k.
        """
        at = np.zeros(len(x[0]), int)
        open_ = [(0, None)]
        while open_:
            node, rows = open_.pop()
            feature = self.feature[node]
            if feature < 0:
                if rows is not None:
                    at[rows] = node
                continue
            if feature >= len(x):
                left = ~same(feature - len(x), self.category[node])
                left = left if rows is None else left[rows]
            else:
                v = x[feature] if rows is None else x[feature][rows]
                left = v <= cuts[node]  # never true of unknown values
                if self.unknown_left[node]:
                    left |= unknown(v)
            sides = (np.flatnonzero(left), np.flatnonzero(~left)) if rows is None else (rows[left], rows[~left])
            open_ += [(self.left[node], sides[0]), (self.right[node], sides[1])]
        return at


def _sampled(key, round_, share, seed):
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        h = (key.view(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


_BLOCK_COLUMNS = ("x", "y", "w", "late", "key", "margin")
_BLOCK_TYPES = (np.uint8, float, float, bool, np.int64, float)
_BLOCK = "x binary, y binary, w binary, late binary, key binary, margin binary"
#: Of category columns: numbers of the values, -1 for NULL, and the values themselves, both per column.
_BLOCK_CATEGORIES = ", codes array<binary>, names array<array<string>>"


def _tables(batches):
    """The rows of a task in tables of BLOCK rows or some more, the last one of fewer."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged(values, counts):
    """Sorted values and counts, those of equal values added up."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _summary(values, most):
    """(distinct values, rows of each) of an array, or `most` values evenly spaced among its rows."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    if len(first) <= most:
        return values[first], np.diff(np.append(first, len(values))).astype(float)
    at = ((np.arange(most) + 0.5) * (len(values) / most)).astype(int)
    return _merged(values[at], np.full(most, len(values) / most))


def _joined(parts, most):
    """One summary of several; a rank is off by 1 in 2 * `most` of the rows more at most."""
    values, counts = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(values, kind="stable")
    values, counts = _merged(values[order], counts[order])
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    at = np.searchsorted(upto, (np.arange(most) + 0.5) * (upto[-1] / most))
    return _merged(values[at], np.full(most, upto[-1] / most))


def _as_block(parts, codes=None, names=None):
    arrays, columns = [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], list(_BLOCK_COLUMNS)
    if codes:
        arrays += [pa.array([[np.ascontiguousarray(c).tobytes() for c in codes]], pa.list_(pa.binary())), pa.array([names], pa.list_(pa.list_(pa.string())))]
        columns += ["codes", "names"]
    return pa.RecordBatch.from_arrays(arrays, names=columns)


def _same(codes, names):
    """Which rows of a block have a value in a category column."""
    return lambda k, value: codes[k] == (names[k].index(value) if value in names[k] else -2)


@dataclass
class BoostedTrees:
    """Squared error, shrinkage, L2 and gain penalties, row and column sampling, early stopping.

    With a `validation` column, rows where it is true do not train, and growing ends when their
    error has not fallen for `patience` rounds, or with a `tolerance` when it falls by less than that share
    after a tree; the trees up to the best round stay. `first_rate` is the learning rate of the first tree.
    Every value of a text column among `categories` is a 0/1 input; NULL is none of them.
    With `known_only` rows with an unknown input do not train.
    """

    inputs: list
    label: str
    rounds: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    bins: int = 255
    validation: str | None = None
    patience: int = 10
    seed: int = 42
    categories: list = field(default_factory=list)
    first_rate: float | None = None
    tolerance: float | None = None
    known_only: bool = False
    base: float = 0.0
    trees: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def _width(self):
        """Columns of a block; without inputs there is a constant one."""
        return max(len(self.inputs), 1)

    def _rate(self, round_):
        return self.first_rate if round_ == 0 and self.first_rate is not None else self.learning_rate

    def _packed(self, rows, *others):
        """The inputs as one array: on the way to Python Spark sizes up every column of a batch again for each row."""
        return rows.select(F.array(*[f"x{i}" for i in range(self._width())]).alias("x"), *others)

    def _used(self):
        """Function of a table: its rows that train or validate, their inputs as floats by number and their columns by name."""
        width, known_only = self._width(), self.known_only

        def used(held):
            x = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width).T
            known = ~np.isnan(x).any(axis=0)
            if known_only and not known.all():
                held, x = held.drop_columns("x").filter(pa.array(known)).combine_chunks(), x[:, known]
            return held, np.ascontiguousarray(x), lambda c: held.column(c).to_numpy().astype(float)

        return used

    def _seen(self, rows):
        """(weighted labels, weights, cuts of every input) of the training rows, from one pass over them.

        Exact for inputs of up to POINTS * bins values; else tasks, groups of tasks and all of them round in turn.
        """
        width, bins, most, used = self._width(), self.bins, POINTS * self.bins, self._used()
        schema, names = "part int, c int, v binary, n binary", ["part", "c", "v", "n"]

        def summaries(part, found):
            found = {c: s for c, s in found.items() if len(s[0])}
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(found), pa.int32()), pa.array(list(found), pa.int32()),
                *[pa.array([np.asarray(s[i], float).tobytes() for s in found.values()], pa.binary()) for i in range(2)]], names=names)

        def run(batches):
            total, levels = np.zeros(2), []
            for held in _tables(batches):
                held, x, column = used(held)
                if not held.num_rows:
                    continue
                early = ~held.column("late").to_numpy().astype(bool)
                w = column("w")
                known = early & ~np.isnan(w)
                total += (w * column("y"))[known].sum(), w[known].sum()
                made = []
                for i in range(width):
                    v = x[i][early]
                    made.append(_summary(v[~np.isnan(v)], most))
                at = 0
                while True:  # a full level is joined into one of the next
                    if at == len(levels):
                        levels.append([])
                    levels[at].append(made)
                    if len(levels[at]) < FAN:
                        break
                    made, levels[at] = [_joined(p, most) for p in zip(*levels[at])], []
                    at += 1
            made = [m for level in levels for m in level]
            yield summaries(TaskContext.get().partitionId() % GROUPS, {
                **{i: _joined(p, most) for i, p in enumerate(zip(*made))}, -1: (total[:1], total[1:])})

        def read(table):
            parts = [tuple(np.frombuffer(table.column(c)[i].as_buffer()) for c in ("v", "n")) for i in range(table.num_rows)]
            c = table.column("c")[0].as_py()
            return c, tuple(np.sum(p, axis=0) for p in zip(*parts)) if c < 0 else _joined(parts, most)

        def join(table):
            c, found = read(table)
            return pa.Table.from_batches([summaries(0, {c: found})])

        def cut(table):
            c, (v, n) = read(table)
            if c >= 0:
                upto = np.cumsum(n)
                at = np.searchsorted(upto, np.ceil(np.arange(1, bins) / bins * upto[-1]))
                v, n = np.unique(v[np.minimum(at, len(v) - 1)]), n[:0]
            return pa.table({"c": pa.array([c], pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64())), "n": pa.array([n.tolist()], pa.list_(pa.float64()))})

        parts = self._packed(rows, "y", "w", "late").mapInArrow(run, schema)
        found = parts.groupBy("part", "c").applyInArrow(join, schema).groupBy("c").applyInArrow(cut, "c int, v array<double>, n array<double>").collect()
        found = {r.c: (r.v, r.n) for r in found}
        (total,), (weight,) = found.get(-1, ([0.0], [0.0]))
        return total, weight, [np.array(found[i][0] if i in found else [], float) for i in range(width)]

    def _binned(self, rows, edges):
        """Blocks of rows: bin numbers column by column, unknown inputs have the last one."""
        bins, width, base, many, used = self.bins, len(edges), self.base, len(self.categories), self._used()

        def block(held, values, column):
            x = np.empty((width, held.num_rows), np.uint8)
            for i, v in enumerate(values):
                x[i] = np.where(np.isnan(v), bins, np.searchsorted(edges[i], v, "left"))
            parts = (x, column("y"), column("w"), held.column("late").to_numpy().astype(bool), held.column("key").to_numpy(), np.full(held.num_rows, base))
            codes, names = [], []
            for k in range(many):
                values = pc.dictionary_encode(held.column(f"c{k}")).combine_chunks()
                codes.append(pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32))
                names.append(values.dictionary.to_pylist())
            return _as_block(parts, codes, names)

        def run(batches):
            for held in _tables(batches):
                held, values, column = used(held)
                if held.num_rows:
                    yield block(held, values, column)

        rows = self._packed(rows, "y", "w", "late", "key", *[f"c{k}" for k in range(many)])
        return rows.mapInArrow(run, _BLOCK + (_BLOCK_CATEGORIES if many else ""))

    def _margins(self, batches, trees):
        """((x, y, w, late, key, margin), codes, names) of every block, the trees added to the margin."""
        bins, width, many = self.bins, self._width(), len(self.categories)
        values = [t.rate * np.array(t.value) for t in trees]
        for b in batches:
            for i in range(b.num_rows):
                x, *rest = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(_BLOCK_COLUMNS, _BLOCK_TYPES))
                x, margin = x.reshape(width, -1), rest.pop().copy()
                codes = [np.frombuffer(c.as_buffer(), np.int32) for c in b.column("codes")[i]] if many else []
                names = b.column("names")[i].as_py() if many else []
                for t, value in zip(trees, values):
                    margin += value[t.walk(x, t.cut, lambda v: v == bins, _same(codes, names))]
                yield (x, *rest, margin), codes, names

    def _histograms(self, table, new, tree, nodes, round_):
        """{(node, column): gradients and weights per bin}, the weighted error of the validation rows and the sums per node and category value.

        The last are a table, as they grow with the values: slot -2 - place of the node, number of the column, value, sums.
        """
        width, slots, bins, margins, share, seed = self._width(), self.bins + 1, self.bins, self._margins, self.row_share, self.seed
        many, columns = len(self.categories), ["slot", "k", "name", "g", "w"]

        def run(batches):
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            sums, late = np.zeros((2, width, len(nodes) * slots)), np.zeros(2)
            for (x, y, w, is_late, key, margin), codes, names in margins(batches, new):
                late += [(w * (y - margin) ** 2)[is_late].sum(), w[is_late].sum()]
                node = place[tree.walk(x, tree.cut, lambda v: v == bins, _same(codes, names))]
                used = np.flatnonzero(~is_late & _sampled(key, round_, share, seed) & (node >= 0))
                g, w, node = (w * (y - margin))[used], w[used], node[used]
                for k in range(many):
                    known = codes[k][used] >= 0
                    pairs, row = np.unique(node[known] * len(names[k]) + codes[k][used][known], return_inverse=True)
                    if len(pairs):
                        at, code = np.divmod(pairs, len(names[k]))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(-2 - at), pa.array(np.full(len(pairs), k, np.int32)), pa.array(names[k], pa.string()).take(pa.array(code)),
                            pa.array(np.bincount(row, g[known])), pa.array(np.bincount(row, w[known]))], names=columns)
                node *= slots
                for c in range(width):
                    at = node + x[c][used]
                    sums[0, c] += np.bincount(at, g, sums.shape[2])
                    sums[1, c] += np.bincount(at, w, sums.shape[2])
            sums = sums.reshape(2, width, len(nodes), slots).swapaxes(1, 2).reshape(2, -1)
            at = np.flatnonzero(sums[1])
            sums = [pa.array(np.append(at, -1)), pa.array(np.append(sums[0][at], late[0])), pa.array(np.append(sums[1][at], late[1]))]
            gap = [pa.nulls(len(at) + 1, pa.int32()), pa.nulls(len(at) + 1, pa.string())] if many else []
            yield pa.RecordBatch.from_arrays([sums[0], *gap, *sums[1:]], names=columns if many else ["slot", "g", "w"])

        keys, kinds = (["slot", "k", "name"], "k int, name string, ") if many else (["slot"], "")
        out = table.mapInArrow(run, f"slot long, {kinds}g double, w double").groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("w").alias("w"))
        by_value = None
        if many:  # one pass over the rows, two over its sums
            by_value = materialize(out)
            out = by_value.where("k IS NULL").select("slot", "g", "w")
        out = out.toArrow()
        slot, g, w = (out.column(c).to_numpy() for c in ("slot", "g", "w"))
        flat = np.zeros((2, len(nodes) * width * slots))
        flat[0, slot[slot >= 0]], flat[1, slot[slot >= 0]] = g[slot >= 0], w[slot >= 0]
        error = (g[slot < 0].sum() / w[slot < 0].sum()) if w[slot < 0].sum() else None
        return flat.reshape(2, len(nodes), width, slots), error, by_value

    def _best_values(self, by_value, hist, round_):
        """{place: (gain, column, value, sums left, sums right)} of the best category value of every node."""
        totals = hist[:, :, 0].sum(axis=2)  # every row is in one bin of the first column
        place = (-2 - F.col("slot")).cast("int")
        total = [F.get(F.array(*[F.lit(float(v)) for v in t]), place) for t in totals]
        left = [t - F.col(c) for t, c in zip(total, "gw")]
        score = lambda g, w: F.when(w + self.l2 > 0, g * g / (w + self.l2)).otherwise(0.0)
        rows = by_value.where("k IS NOT NULL")
        if self.column_share < 1:
            share = F.pmod(F.xxhash64("k", "name", F.lit(self.seed), F.lit(round_)), F.lit(1 << 20))
            rows = rows.where(share < int(self.column_share * (1 << 20)))
        rows = rows.withColumn("gain", score(F.col("g"), F.col("w")) + score(*left) - score(*total)).where(
            (F.col("w") >= self.min_weight) & (left[1] >= self.min_weight) & (F.col("gain") > max(2 * self.min_gain, 1e-12)))
        best = rows.groupBy(place.alias("place")).agg(F.max(F.struct("gain", "k", "name", "g", "w")).alias("b")).collect()
        return {r.place: (r.b.gain, r.b.k, r.b.name, tuple(totals[:, r.place] - [r.b.g, r.b.w]), (r.b.g, r.b.w)) for r in best}

    def _best(self, hist, edges, columns):
        """(gain, column, cut, unknown left, sums left, sums right) of one node, or None."""
        best = None
        score = lambda g, w: g * g / (w + self.l2) if w + self.l2 > 0 else 0.0
        scores = lambda g, w: np.divide(g * g, w + self.l2, out=np.zeros_like(g), where=w + self.l2 > 0)
        for c in columns:
            n = len(edges[c])
            g, w = hist[:, c]
            total, gap = (g.sum(), w.sum()), (g[self.bins], w[self.bins])
            below = np.cumsum(g[:n]), np.cumsum(w[:n])
            for left_gap in ((True, False) if gap[1] else (True,)):
                gl, wl = (below[0] + gap[0], below[1] + gap[1]) if left_gap else below
                gr, wr = total[0] - gl, total[1] - wl
                gain = scores(gl, wl) + scores(gr, wr) - score(*total)
                gain = np.where((wl >= self.min_weight) & (wr >= self.min_weight), gain, -np.inf)
                i = int(gain.argmax()) if n else 0
                if n and gain[i] > max(2 * self.min_gain, 1e-12) and (best is None or gain[i] > best[0] + 1e-12):
                    best = (float(gain[i]), c, i, left_gap, (gl[i], wl[i]), (gr[i], wr[i]))
        return best

    def fit(self, df: DataFrame, weight=None) -> "BoostedTrees":
        """Rows without a label take no part; unknown inputs do. `df` is read twice: write it first if it is costly."""
        x = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(self.inputs)] or [F.lit(0.0).alias("x0")]
        names = [F.col(quoted(c)).cast("string").alias(f"c{k}") for k, c in enumerate(self.categories)]
        late = F.coalesce(F.col(quoted(self.validation)), F.lit(False)) if self.validation else F.lit(False)
        y = F.col(quoted(self.label)).cast("double")
        rows = df.where(F.col(quoted(self.label)).isNotNull()).select(
            *x, y.alias("y"), (F.col(quoted(weight)).cast("double") if weight else F.lit(1.0)).alias("w"), late.alias("late"), *names,
            F.xxhash64(y, F.monotonically_increasing_id()).alias("key"))
        total, weights, edges = self._seen(rows)
        if not weights:
            raise ValueError("No rows to fit")
        self.base, self.trees, self.errors = total / weights, [], []
        table = materialize(self._binned(rows, edges))
        new, best_round = [], 0
        for round_ in range(self.rounds):
            rng = np.random.default_rng([self.seed, round_])
            columns = sorted(rng.choice(len(x), max(1, round(self.column_share * len(x))), replace=False).tolist())
            tree, nodes, error = Tree(self._rate(round_)), [0], None
            for depth in range(self.max_depth):
                hist, found, by_value = self._histograms(table, new, tree, nodes, round_)
                values = {}
                if by_value is not None:
                    values = self._best_values(by_value, hist, round_)
                    forget(by_value)
                if depth == 0:
                    error = found
                    all_g, all_w = hist[:, 0, 0].sum(axis=1)
                    tree.value[0], tree.cover[0] = (all_g / (all_w + self.l2) if all_w else 0.0), all_w
                following = []
                for j, at in enumerate(nodes):
                    best, value = self._best(hist[:, j], edges, columns), values.get(j)
                    if value is not None and (best is None or value[0] > best[0] + 1e-12):
                        gain, k, name, *sides = value
                        children = tree.split(at, self._width() + k, 0, 0.0, True, gain, name)
                    elif best is not None:
                        gain, c, cut, left_gap, *sides = best
                        children = tree.split(at, c, cut, float(edges[c][cut]), left_gap, gain)
                    else:
                        continue
                    for child, (g, w) in zip(children, sides):
                        tree.value[child], tree.cover[child] = g / (w + self.l2), w
                        following.append(child)
                nodes = following
                if not nodes:
                    break
            if error is not None:  # of the trees before this one
                self.errors.append(error)
                best_round = int(np.argmin(self.errors))
                if self.tolerance is not None:
                    if len(self.errors) > 2 and min(self.errors[1:-1]) - error < self.tolerance * max(error, 0.01):
                        break
                elif round_ - best_round >= self.patience:
                    break
            self.trees.append(tree)
            new.append(tree)
            if len(new) == KEEP_EVERY and round_ + 1 < self.rounds:
                old, table = table, materialize(self._kept(table, new))
                forget(old)
                new = []
        if self.errors:
            self.trees = self.trees[: max(best_round, 1)] if len(self.errors) < self.rounds else self.trees
        forget(table)
        return self

    def _kept(self, table, new):
        margins = self._margins

        def run(batches):
            for parts, codes, names in margins(batches, new):
                yield _as_block(parts, codes, names)

        return table.mapInArrow(run, table.schema)

    def transform(self, df: DataFrame, where=None) -> DataFrame:
        """Add `prediction` for every row, or those where a condition holds; unknown inputs go the way learned for them."""
        if not self.trees:
            raise RuntimeError("Call fit before predict")
        trees, base, width = self.trees, self.base, self._width()
        asked = {f for t in trees for f in t.feature if f >= 0}
        numbers, texts = [f for f in sorted(asked) if f < width and self.inputs], [f - width for f in sorted(asked) if f >= width]
        columns = [F.col(quoted(self.inputs[f])).cast("double") for f in numbers] + [F.col(quoted(self.categories[k])).cast("string") for k in texts]

        @F.pandas_udf("double")
        def predict(asked: pd.Series, *columns: pd.Series) -> pd.Series:
            x = [np.empty(len(asked))] * width  # of inputs that no tree asks for, just the length
            for f, c in zip(numbers, columns):
                x[f] = c.to_numpy(dtype=float)
            same = lambda k, value: (columns[len(numbers) + texts.index(k)] == value).fillna(False).to_numpy(dtype=bool)
            out = np.full(len(x[0]), base)
            for t in trees:
                out += t.rate * np.array(t.value)[t.walk(x, t.limit, np.isnan, same)]
            return pd.Series(out).where(asked.to_numpy(dtype=bool))

        # The condition is an input, as one on the result would be worked out again wherever that is used.
        return df.withColumn("prediction", predict(F.lit(True) if where is None else where, *columns))

    def evaluate(self, df: DataFrame, *by) -> DataFrame:
        return error_metrics(self.transform(df), self.label, "prediction", *by)

    def node_table(self, spark=None) -> DataFrame:
        """One row per node of every tree; leaves have no feature."""
        rows, width = [], self._width()
        for r, t in enumerate(self.trees):
            for i, f in enumerate(t.feature):
                inner = f >= 0
                name = (self.inputs[f] if f < width else self.categories[f - width]) if inner else None
                rows.append((r, i, name, float(t.limit[i]) if inner else None, bool(t.unknown_left[i]) if inner else None, int(t.left[i]) if inner else None,
                             int(t.right[i]) if inner else None, float(t.value[i]), float(t.gain[i]), float(t.cover[i]), t.category[i]))
        return (spark or SparkSession.active()).createDataFrame(rows, NODE)

    def importance(self, by="count") -> DataFrame:
        """Shares that sum to 1, of how often each input splits a node (`count`) or of its gains (`gain`)."""
        if by not in ("count", "gain"):
            raise ValueError("by must be 'count' or 'gain'")
        inner = self.node_table().where("feature IS NOT NULL")
        score = F.count("*").cast("double") if by == "count" else F.sum("gain")
        return normalise(inner.groupBy("feature").agg(score.alias("score")))

    def save(self, folder: str):
        """Nodes and settings below one folder, written by Spark."""
        self.node_table().coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
        config = {k: v for k, v in asdict(self).items() if k != "trees"}
        SparkSession.active().createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")

    @classmethod
    def load(cls, spark, folder: str) -> "BoostedTrees":
        out = cls(**json.loads(spark.read.text(f"{folder}/config").first()[0]))
        for r in spark.read.parquet(f"{folder}/nodes").orderBy("round", "node").collect():
            if r.node == 0:
                out.trees.append(Tree(out._rate(r["round"])))
            t = out.trees[-1]
            if r.feature is not None:
                at = out.inputs.index(r.feature) if r.category is None else out._width() + out.categories.index(r.feature)
                t.split(r.node, at, 0, r.cut, r.unknown_left, r.gain, r.category)
                t.left[r.node], t.right[r.node] = r.left, r.right
            t.value[r.node], t.cover[r.node] = r.value, r.cover
        return out


@dataclass
class CategoryForecaster(Forecaster):
    """`Boosting` settings on numeric inputs and text columns of any number of values.

    `encoded` maps an input to the text column whose values it stands for, each a 0/1 input as in a one-hot vector.
    As with Spark ML's boosting the first tree counts in full and rows with an unknown input take no part;
    columns are sampled per tree, and there are at most 255 bins.
    """

    encoded: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, weight=None) -> "CategoryForecaster":
        s, plain = self.settings, [c for c in self.inputs if c not in self.encoded]
        model = BoostedTrees(
            plain, self.label, rounds=s.rounds, max_depth=s.max_depth, learning_rate=s.learning_rate, row_share=s.row_share,
            column_share=s.column_share, l2=0.0, min_weight=s.min_leaf, bins=min(s.max_bins, 255), validation=s.validation, seed=s.seed,
            categories=list(self.encoded.values()), first_rate=1.0, tolerance=s.tolerance if s.validation else None, known_only=True)
        self.model = model.fit(df.na.drop("any", subset=[self.label]), weight)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._fitted().transform(df, self._known(df))

    def input_names(self):
        return list(self.inputs)

    def importance(self) -> DataFrame:
        """Shares of the split gains that sum to 1, one row per input; the values of a text column add up."""
        names = {c: i for i, c in self.encoded.items()}
        scores = dict.fromkeys(self.inputs, 0.0)
        model = self._fitted()
        for t in model.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    scores[model.inputs[f] if f < model._width() else names[model.categories[f - model._width()]]] += gain
        return normalise(self._session().createDataFrame(list(scores.items()), "feature string, score double"))

    def coefficients(self) -> DataFrame:
        raise ValueError("Trees have no coefficients")

    def save(self, folder: str):
        self._fitted().save(f"{folder}/model")
        text = json.dumps({"settings": asdict(self.settings), "inputs": self.inputs, "label": self.label, "encoded": self.encoded})
        self._session().createDataFrame([(text,)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")

    @classmethod
    def load(cls, spark, folder: str) -> "CategoryForecaster":
        config = json.loads(spark.read.text(f"{folder}/config").first()[0])
        model = BoostedTrees.load(spark, f"{folder}/model")
        return cls(Boosting(**config["settings"]), config["inputs"], config["label"], [], model, config["encoded"])
