"""Near-duplicate vectors: a robust-pruned flat graph searched by range-expanding greedy walks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


from firn.llm.components import components
from firn.session import materialize

COSINE = 0.93
#: Vectors per shard, about; spaces with no more are one shard.
SHARD = 1_000
#: Shards a vector belongs to, its nearest centres first.
OVERLAP = 2
#: Vectors the centres are fitted on, about, and the most centres of all; larger shards are cut into blocks.
SAMPLE = 20_000
CENTRES = 2_048
BLOCK = 4_000
#: Candidates and out-edges per node, random candidates among them, stretch of the pruning rule.
NEAREST, RANDOM, DEGREE, ALPHA = 32, 12, 20, 1.2
BACK = 4
#: Nodes a walk expands at least; it goes on while nodes in range are left.
BEAM = 24
#: Vectors checked against all others by brute force, about, and the share of links that must be found.
AUDIT = 512
RECALL = 0.99


def unit_rows(vectors):
    """Vectors as unit rows in double precision."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(x, cand, alpha=ALPHA, degree=DEGREE):
    """Out-edges per node from its candidates: the nearest stays and puts out all that it is closer to, by alpha.

    `cand` (n, c) holds row numbers by rising distance, -1 for none. Returns (n, degree) in the same way.
    """
    n, c = cand.shape
    out = np.full((n, degree), -1, np.int64)
    for lo in range(0, n, 256):
        part = cand[lo : lo + 256]
        m = len(part)
        v = x[part]
        d0 = np.sqrt(np.maximum(2 - 2 * np.einsum("icd,id->ic", v, x[lo : lo + 256]), 0))
        dc = np.sqrt(np.maximum(2 - 2 * np.einsum("icd,ied->ice", v, v), 0))
        alive = part >= 0
        row = np.arange(m)
        for k in range(degree):
            left = alive.any(axis=1)
            if not left.any():
                break
            pick = alive.argmax(axis=1)
            out[lo : lo + m, k] = np.where(left, part[row, pick], -1)
            near = alpha * dc[row, pick] <= d0
            alive &= ~near
            alive[row, pick] = False
    return out


def build_graph(x, seed=3):
    """Adjacency of one shard: pruned nearest and random candidates and the edges back.

    A node takes 2 * DEGREE edges back, its nearest ones, and those from nodes that have it among
    their first BACK, so no node is left without edges to it.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(seed)
    k = min(NEAREST, n - 1)
    cand = np.full((n, k + RANDOM), -1, np.int64)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
        cand[lo : lo + 512, :k] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        cand[lo : lo + 512, k:] = rng.integers(0, n, (len(s), RANDOM))
    cand[cand == np.arange(n)[:, None]] = -1
    cand.sort(axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    sim = np.einsum("ncd,nd->nc", x[cand], x) if n * cand.shape[1] * x.shape[1] < 1 << 25 else np.concatenate([np.einsum("ncd,nd->nc", x[cand[i : i + 256]], x[i : i + 256]) for i in range(0, n, 256)])
    sim[cand < 0] = -9
    order = np.argsort(-sim, axis=1, kind="stable")
    cand = np.take_along_axis(cand, order, axis=1)
    out = robust_prune(x, cand)
    src, slot = np.nonzero(out >= 0)
    dst = out[src, slot]
    dist = -np.einsum("ed,ed->e", x[src], x[dst]) if len(src) < 1 << 17 else -np.concatenate([np.einsum("ed,ed->e", x[src[i : i + 65536]], x[dst[i : i + 65536]]) for i in range(0, len(src), 65536)])
    order = np.lexsort([dist, dst])
    back, to = src[order], dst[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to, side="left")
    stay = (rank < 2 * DEGREE) | (slot[order] < BACK)
    back, to = back[stay], to[stay]
    a, b = np.concatenate([src, to]), np.concatenate([dst, back])
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def medoid(x):
    return int((x @ x.mean(axis=0)).argmax())


def range_search(x, edges, queries, own, threshold=COSINE, beam=BEAM):
    """Per query the nodes at a cosine of the threshold or more that the walk meets.

    All queries of a chunk walk in step. A walk starts at the medoid and at the query's own node,
    if it has one (own >= 0). It expands its best open node as long as it has expanded fewer than
    `beam` or that node is in range.
    """
    n = len(x)
    width = max((len(e) for e in edges), default=0)
    adj = np.full((n, max(width, 1)), -1, np.int64)
    for i, e in enumerate(edges):
        adj[i, : len(e)] = e
    start = medoid(x)
    found = []
    for lo in range(0, len(queries), 128):
        q, me = queries[lo : lo + 128], own[lo : lo + 128]
        m = len(q)
        sim = np.full((m, n + 1), -2.0)
        open_ = np.full((m, n + 1), -2.0)
        row = np.arange(m)
        first = np.where(me >= 0, me, start)
        for at in (np.full(m, start), first):
            s = np.einsum("id,id->i", x[at], q)
            sim[row, at] = s
            open_[row, at] = s
        live, steps = row, 0
        while len(live):
            best = open_[live, :n].argmax(axis=1)
            s = open_[live, best]
            go = (s > -2) & ((s >= threshold) | (steps < beam))
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = -2
            nb = adj[best]
            r, c = np.nonzero((nb >= 0) & (sim[live[:, None], nb] == -2))
            node, who = nb[r, c], live[r]
            s = np.einsum("id,id->i", x[node], q[who])
            sim[who, node] = s
            open_[who, node] = s
            steps += 1
        hit = sim[:, :n] >= threshold
        found += [np.flatnonzero(h) for h in hit]
    return found


def fit_centres(space_rows, counts, seed=9):
    """{space: centres} from a bounded sample, for the spaces with more than SHARD vectors."""
    rng = np.random.default_rng(seed)
    total = sum(counts.values())
    out = {}
    for space, vectors in sorted(space_rows.items()):
        x = unit_rows(vectors)
        k = -(-counts[space] // SHARD)
        k = max(1, min(k, CENTRES * counts[space] // max(total, 1) + 1, len(x)))
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(6):
            best = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, best, x)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        out[space] = c
    return out


def vector_classes(df, id_col, vec_col, label_col):
    """(id, space, node) per row, and one row per class of equal vectors of a space: node, space, m, least, v.

    `space` is label and length; it is null for vectors that link with nothing.
    """
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    space = F.when(F.coalesce(good, F.lit(False)), F.concat_ws("/", F.col(label_col).cast("string"), F.size(v).cast("string")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), space.alias("space"), v.alias("v"))
    rows = rows.withColumn("node", F.when(F.col("space").isNotNull(), F.xxhash64("space", "v")))
    classes = rows.where("space IS NOT NULL").groupBy("node").agg(F.first("space").alias("space"), F.count("*").alias("m"), F.min("id").alias("least"), F.first("v").alias("v"))
    return rows.drop("v"), materialize(classes)


def assigned(classes, centres, overlap):
    """Each class with its shards, the nearest first; a space without centres is one shard."""
    base, at = {}, 0
    for s, c in centres.items():
        base[s], at = at, at + len(c)

    def run(batches):
        for b in batches:
            spaces, vecs = b.column("space").to_pylist(), b.column("v").to_pylist()
            shards = [[-1]] * len(spaces)
            for s in set(spaces) & centres.keys():
                rows = [i for i, x in enumerate(spaces) if x == s]
                near = unit_rows([vecs[i] for i in rows]) @ centres[s].T
                top = np.argsort(-near, axis=1, kind="stable")[:, :overlap] + base[s]
                for i, t in zip(rows, top.tolist()):
                    shards[i] = t
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*b.schema.names, "shards"])

    return classes.mapInArrow(run, "node long, space string, m long, least long, v array<double>, shards array<long>")


def _order(table):
    return np.argsort(table["node"].to_numpy(), kind="stable")


def shard_edges(members):
    """(node, near): every shard's graph as adjacency lists of nodes."""

    def build(key, table):
        order = _order(table)
        node = table["node"].to_numpy()[order]
        v = table["v"].to_pylist()
        edges = build_graph(unit_rows([v[i] for i in order]))
        return pa.table([pa.array(node), pa.array([node[e] for e in edges], pa.list_(pa.int64()))], names=["node", "near"])

    return members.groupBy("space", "shard", "block").applyInArrow(build, "node long, near array<long>")


def shard_links(walks):
    """(node, links, hits, root): per shard what a node's walk found, rows and classes.

    A pair that shares several shards counts in the first of them. Components within the shard
    are tied to their smallest node.
    """

    def search(key, table):
        table = table.take(pa.array(_order(table)))
        role = table["role"].to_numpy()
        v, shards, m, near = (table[c].to_pylist() for c in ("v", "shards", "m", "near"))
        x = unit_rows(v)
        node = table["node"].to_numpy()
        inside = np.flatnonzero(role & 1)
        asks = np.flatnonzero(role & 2)
        none = pa.table([pa.array([], t) for t in (pa.int64(),) * 4], names=["node", "links", "hits", "root"])
        if not len(inside) or not len(asks):
            return none
        place = {int(node[i]): k for k, i in enumerate(inside)}
        edges = [np.array([place[e] for e in near[i] or () if e in place], np.int64) for i in inside]
        own = np.array([place.get(int(node[i]), -1) for i in asks])
        here = key[1].as_py()
        found = range_search(x[inside], edges, x[asks], own)
        links, classes, pairs = np.zeros(len(asks), np.int64), np.zeros(len(asks), np.int64), []
        for k, (i, hits) in enumerate(zip(asks.tolist(), found)):
            hits = inside[hits]
            hits = hits[hits != i] if role[i] & 1 else hits[node[hits] != node[i]]
            if len(hits):
                mine = set(shards[i])
                first = [j for j in hits.tolist() if min(mine.intersection(shards[j])) == here]
                links[k], classes[k] = sum(m[j] for j in first), len(first)
                pairs.append((np.full(len(hits), i), hits))
        root = np.arange(len(node))
        if pairs:
            a, b = (np.concatenate(p) for p in zip(*pairs))
            while True:
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                root = root[root]
                if (root == before).all():
                    break
        tied = np.flatnonzero(root != np.arange(len(node)))
        none_tied = np.zeros(len(tied), np.int64)
        return pa.table([np.concatenate([node[asks], node[tied]]), np.concatenate([links, none_tied]), np.concatenate([classes, none_tied]), np.concatenate([node[asks], node[root[tied]]])], names=["node", "links", "hits", "root"])

    return walks.groupBy("space", "shard", "block", "chunk").applyInArrow(search, "node long, links long, hits long, root long")


def link_classes(classes, centres, overlap):
    """(node, links, hits, root) over all shards, blocks of large shards each against each."""
    near = materialize(assigned(classes, centres, overlap))
    each = near.select("*", F.explode("shards").alias("shard"))
    size = each.groupBy(F.col("space").alias("of"), F.col("shard").alias("s")).count().where(F.col("count") > BLOCK)
    size = materialize(size.select("of", "s", F.ceil(F.col("count") / BLOCK).alias("cut")))
    large = size.count()  # at most rows / BLOCK
    size = F.broadcast(size) if large <= 10_000 else size
    each = each.join(size, (each.space == size.of) & (each.shard == size.s), "left").withColumn("blocks", F.coalesce("cut", F.lit(1))).drop("of", "s", "cut")
    each = each.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int"))
    edges = materialize(shard_edges(each.select("space", "shard", "block", "node", "v")))
    union = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("node", "node2")
    union = materialize(union)
    each = each.join(union, each.node == union.node2).drop("node2")
    one = each.where("blocks = 1").select("space", "shard", "block", F.lit(0).alias("chunk"), "node", "v", "m", "shards", "near", F.lit(3).alias("role"))
    if large:
        many = each.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = many.select("space", "shard", "block", F.col("other").alias("chunk"), "node", "v", "m", "shards", "near", F.when(F.col("other") == F.col("block"), 3).otherwise(1).alias("role"))
        asks = many.where("other <> block").select("space", "shard", F.col("other").alias("block"), F.col("block").alias("chunk"), "node", "v", "m", "shards", "near", F.lit(2).alias("role"))
        one = one.union(held).union(asks)
    return materialize(shard_links(one))


def audit(classes, links, sample=AUDIT):
    """Mean share of the neighbour classes found for about `sample` classes that have any, by brute force over all classes.

    Every asked class counts the same, and copies of a neighbour once, so a hot group does not hide
    what ordinary ones lost. Classes of about as many neighbours also have their own mean where a
    hundred or more are asked, which is what a hundredth takes to show; the smallest mean is returned.
    """
    n = classes.count()
    u = F.pmod(F.xxhash64(F.lit(77), "node"), F.lit(1 << 40))
    picked = classes.where(u < int((1 << 40) * min(1.0, sample / max(n, 1)))).select("node", "space", "v").collect()
    if not picked:
        return 1.0
    by = {}
    for r in picked:
        by.setdefault(r.space, []).append((r.node, r.v))
    asked = {s: (np.array([a for a, _ in x]), unit_rows([v for _, v in x])) for s, x in by.items()}

    def run(batches):
        for b in batches:
            spaces, nodes, vecs = (b.column(c).to_pylist() for c in ("space", "node", "v"))
            out, count = [], []
            for s in set(spaces) & asked.keys():
                rows = [i for i, x in enumerate(spaces) if x == s]
                who, q = asked[s]
                hit = (q @ unit_rows([vecs[i] for i in rows]).T >= COSINE) & (who[:, None] != np.array([nodes[i] for i in rows])[None, :])
                out += who.tolist()
                count += hit.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(count, pa.int64())], names=["who", "n"])

    want = {r.who: r.n for r in classes.mapInArrow(run, "who long, n long").groupBy("who").agg(F.sum("n").alias("n")).collect()}
    got = {r.node: r.n for r in links.where(F.col("node").isin([int(w) for w in want])).groupBy("node").agg(F.sum("hits").alias("n")).collect()}
    every, strata = [], {}
    for k, v in want.items():
        if v:
            every.append(min(got.get(k, 0) / v, 1.0))
            strata.setdefault(v.bit_length() // 3, []).append(every[-1])
    return float(min((np.mean(x) for x in [every, *(x for x in strata.values() if len(x) >= 100)] if x), default=1.0))


def near_vectors(df, id_col="vec_id", vec_col="embedding", label_col="label", overlap=OVERLAP, recall=RECALL):
    """Per row: id, n_links, component_id, kept and the audited share of links found, `recall` (see `audit`).

    Two rows are linked when their labels and lengths are equal and their cosine, in doubles, is
    COSINE or more. Equal vectors of a label are one node that stands for all its rows. Vectors
    that are null, empty, zero or hold null or non-finite components, and those with a null
    label, link with nothing. A component is named by its smallest id that is not null, else
    null. `kept` is id = component_id; rows without an id are kept only if no row of their
    component has one. Repeated rows are linked like any others. An empty table gives no rows.
    Where the audit's smallest mean is below `recall`, everything is done again with twice
    the overlap, up to all centres of a space.
    """
    rows, classes = vector_classes(df, id_col, vec_col, label_col)
    large = classes.groupBy("space").count().where(F.col("count") > SHARD)
    counts = {r.space: r["count"] for r in large.collect()}  # at most rows / SHARD, bounded below
    centres = {}
    if counts:
        total = sum(counts.values())
        u = F.pmod(F.xxhash64(F.lit(13), "node"), F.lit(1 << 40))
        picked = classes.join(F.broadcast(large.select(F.col("space").alias("s"))), F.col("space") == F.col("s")).where(u < int((1 << 40) * min(1.0, SAMPLE / total)))
        sample = {}
        for r in sorted(picked.select("space", "node", "v").collect(), key=lambda r: (r.space, r.node)):
            sample.setdefault(r.space, []).append(r.v)
        centres = fit_centres(sample, counts)
    most = max((len(c) for c in centres.values()), default=1)
    while True:
        links = link_classes(classes, centres, overlap)
        share = audit(classes, links)
        if share >= recall or overlap >= most:
            break
        overlap *= 2
    count = materialize(links.groupBy(F.col("node").alias("at")).agg(F.sum("links").alias("links")))
    comp = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.select("node", "m", "least").join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    of = materialize(of.select("node", "m", "least", F.coalesce("component", "node").alias("component")))
    top = materialize(of.groupBy("component").agg(F.min("least").alias("component_id")))
    of = of.join(top, "component").join(count, F.col("node") == F.col("at"), "left")
    of = materialize(of.select(F.col("node").alias("node2"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.join(of, rows.node == of.node2, "left")
    own = F.when(F.col("node2").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), F.lit(float(share)).alias("recall"))
