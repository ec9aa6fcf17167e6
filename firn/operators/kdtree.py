"""A K-d tree over rows with unknown numbers, built and searched inside a task.

Every inner node splits one column in three: rows that do not know it, rows up to a cut, rows
above it. Distance is Euclidean over the columns both rows know, squared and scaled by the
share known. Columns that some row of a node does not know set no bound on the node, so one
tree serves every pattern of unknown columns.
"""

import numpy as np

#: Rows of a leaf, and pairs compared at once.
LEAF, PAIRS = 32, 1 << 20


class Tree:
    """Nodes as arrays: the column split (-1 for leaves), its cut, three children and a range of `order`."""

    def __init__(self, x, size=LEAF):
        order, nodes, boxes = np.arange(len(x)), [], []
        stack = [(0, len(x), None, None)]
        while stack:
            lo, hi, parent, place = stack.pop()
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, -1, lo, hi])
            if parent is not None:
                nodes[parent][2 + place] = at
            own = order[lo:hi]
            rows = x[own]
            unknown = np.isnan(rows).any(axis=0)
            boxes.append((np.where(unknown, -np.inf, rows.min(axis=0)), np.where(unknown, np.inf, rows.max(axis=0))))
            if hi - lo <= size:
                continue
            split = _split(rows)
            if split is None:  # all in one place
                continue
            c, cut = split
            v = rows[:, c]
            side = np.where(np.isnan(v), 0, np.where(v <= cut, 1, 2))
            order[lo:hi] = own[np.argsort(side, kind="stable")]
            nodes[at][:2] = [c, cut]
            for place, n in enumerate(np.bincount(side, minlength=3).tolist()):
                if n:
                    stack.append((lo, lo + n, at, place))
                    lo += n
        self.order = order
        table = np.array(nodes, float)
        self.column, self.child = table[:, 0].astype(int), table[:, 2:5].astype(int)
        self.cut, self.first, self.last = table[:, 1], table[:, 5].astype(int), table[:, 6].astype(int)
        self.low, self.high = (np.array(b) for b in zip(*boxes))

    def bound_by(self, low, high):
        """Set the boxes of the leaves and, from them, those of all nodes above; leaves without rows are never near."""
        leaf = self.column < 0
        self.low[leaf], self.high[leaf] = low, high
        for at in np.flatnonzero(~leaf)[::-1]:  # children come after their parent
            kids = self.child[at][self.child[at] >= 0]
            self.low[at], self.high[at] = self.low[kids].min(axis=0), self.high[kids].max(axis=0)

    def home(self, q):
        """The leaf each row falls into; where it does not know the column, the child with most rows."""
        at = np.zeros(len(q), int)
        while True:
            inner = np.flatnonzero(self.column[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            v = q[inner, self.column[node]]
            kids = self.child[node]
            size = np.where(kids >= 0, (self.last - self.first)[kids], -1)
            want = np.where(v <= self.cut[node], 1, 2)
            chosen = kids[np.arange(len(node)), want]
            at[inner] = np.where(np.isnan(v) | (chosen < 0), kids[np.arange(len(node)), size.argmax(axis=1)], chosen)

    def place(self, x):
        """The leaf a row of the tree's own kind belongs to: like `home`, but unknown values go where unknown ones went."""
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.column[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            v = x[inner, self.column[node]]
            kids = self.child[node]
            side = np.where(np.isnan(v), 0, np.where(v <= self.cut[node], 1, 2))
            chosen = kids[np.arange(len(node)), side]
            at[inner] = np.where(chosen >= 0, chosen, kids.max(axis=1))

    def reach(self, q, scale, bound):
        """(row, leaf, near) for every leaf that may hold a row within `bound`."""
        who, at = np.arange(len(q)), np.zeros(len(q), int)
        found = []
        while len(who):
            near = np.zeros(len(who))
            for c in range(q.shape[1]):
                v = q[who, c]
                gap = np.maximum(np.maximum(self.low[at, c] - v, v - self.high[at, c]), 0.0)
                near += np.where(np.isnan(v), 0.0, gap * gap)
            near = scale[who] * near
            close = near <= bound[who]
            who, at, near = who[close], at[close], near[close]
            leaf = self.column[at] < 0
            found.append((who[leaf], at[leaf], near[leaf]))
            kids = self.child[at[~leaf]]
            who, at = np.repeat(who[~leaf], 3), kids.ravel()
            who, at = who[at >= 0], at[at >= 0]
        return tuple(np.concatenate(p) for p in zip(*found))


def _split(rows):
    """The column with the widest spread and a cut with rows on both sides; or one that only some know."""
    known = ~np.isnan(rows)
    count = known.sum(axis=0)
    mean = np.where(known, rows, 0.0).sum(axis=0) / np.maximum(count, 1)
    spread = np.where(known, (rows - mean) ** 2, 0.0).sum(axis=0)
    c = int(spread.argmax())
    if spread[c] > 0:
        v = rows[known[:, c], c]
        cut = float(np.median(v))
        if cut < v.max():
            return c, cut
        below = v[v < v.max()]
        if len(below):
            return c, float(below.max())
    mixed = np.flatnonzero((count > 0) & (count < len(rows)))
    return (int(mixed[0]), np.inf) if len(mixed) else None


def scales(q, width):
    """What a sum of squares over all columns the row knows counts at least."""
    return width / np.maximum((~np.isnan(q)).sum(axis=1), 1)


class Nearest:
    """The k nearest of weighted rows (x, v, m), for batches of searching rows."""

    def __init__(self, x, v, m, k, width):
        self.x, self.v, self.m, self.k, self.width = x, v, m, k, width
        self.tree = Tree(x)
        self.compared = 0

    def _met(self, q, who, leaf):
        """(row, d, v, m) of all pairs of a row and a member of its leaf that share a column."""
        size = self.tree.last[leaf] - self.tree.first[leaf]
        part = np.cumsum(size) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(who)]
        for lo, hi in zip(cuts, cuts[1:]):
            s = size[lo:hi]
            row = np.repeat(who[lo:hi], s)
            member = self.tree.order[np.arange(len(row)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.tree.first[leaf[lo:hi]], s)]
            self.compared += len(row)
            total, shared = np.zeros(len(row)), np.zeros(len(row))
            for c in range(q.shape[1]):
                diff = q[row, c] - self.x[member, c]
                known = ~np.isnan(diff)
                total += np.where(known, diff * diff, 0.0)
                shared += known
            ok = shared > 0
            yield row[ok], (self.width / shared[ok]) * total[ok], self.v[member[ok]], self.m[member[ok]]

    def _best(self, best, parts, n):
        """The k nearest of those so far and new ones, ties by the smaller value; and the distance of the last."""
        row, d, v, m = (np.concatenate(p) for p in zip(best, *parts))
        order = np.lexsort((v, d, row))
        row, d, v, m = row[order], d[order], v[order], m[order]
        total = np.cumsum(m)
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        base = np.repeat((total - m)[start], np.diff([*start, len(row)]))
        before = total - m - base
        keep = before < self.k
        bound = np.full(n, np.inf)
        last = keep & (before + m >= self.k)
        bound[row[last]] = d[last]
        return (row[keep], d[keep], v[keep], m[keep]), bound

    def search(self, q, bound):
        """(row, d, v, m): of every row the nearest that are not beyond `bound`, copies counted.

        First its own leaf, whose k-th distance bounds the rest; then the other leaves within the
        bound from the nearest outward, one, two, four at a time, while the bound shrinks.
        """
        n, scale = len(q), scales(q, self.width)
        home = self.tree.home(q)
        best = tuple(np.zeros(0, t) for t in (int, float, float, np.int64))
        best, own = self._best(best, list(self._met(q, np.arange(n), home)), n)
        limit = np.minimum(bound, own)
        who, leaf, near = self.tree.reach(q, scale, limit)
        other = leaf != home[who]
        who, leaf, near = who[other], leaf[other], near[other]
        order = np.lexsort((near, who))
        who, leaf, near = who[order], leaf[order], near[order]
        step = 1
        while len(who):
            start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            rank = np.arange(len(who)) - np.repeat(start, np.diff([*start, len(who)]))
            now = rank < step
            best, own = self._best(best, list(self._met(q, who[now], leaf[now])), n)
            limit = np.minimum(limit, own)
            left = ~now & (near <= limit[who])
            who, leaf, near = who[left], leaf[left], near[left]
            step *= 2
        ok = best[1] <= bound[best[0]]
        return tuple(b[ok] for b in best)
