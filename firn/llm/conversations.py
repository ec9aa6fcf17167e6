"""A prefix trie over conversations: who shares which first turns, and totals of every subtree."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firn.llm.common import attach
from firn.llm.sql import CRC_TABLE, crc_sql
from firn.llm.trees import subtree_totals
from firn.session import materialize

#: Turns of one conversation that are hashed in one window; longer ones are cut and put together.
CHUNK = 4096
#: Bytes of joined ids per row while member lists are hashed.
PIECE = 1 << 16


def text_turns(df, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """(conv, pos, t1, t2, words): the turns of every conversation numbered from 1.

    Ordered by turn (null first), then role and text; repeated rows stay. A null role or text
    is empty; rows without a conversation are left out. t1 and t2 stand for role and text. All
    rows are sorted once over the whole table, so that no task holds a whole long conversation;
    the few that go on in the next partition are put together from the counts.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    d = d.where("conv IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.select("conv", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(5), "text", "role").alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            pos = np.arange(1, len(conv) + 1) - np.repeat(start, np.diff([*start, len(conv)]))
            if conv[0] == last:
                pos[: len(conv) if len(start) == 1 else start[1]] += seen
            last, seen = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int64)), pa.array(pos.astype(np.int64)), *b.columns], names=["part", "pos", *b.schema.names])

    turns = materialize(d.mapInArrow(number, "part long, pos long, conv long, t1 long, t2 long, words long"))
    per = turns.groupBy("conv", "part").agg(F.max("pos").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # a partition goes on with one conversation at most: one row per partition or fewer
    offset = per.select("conv", "part", before.alias("before")).where("before > 0")
    turns = turns.join(F.broadcast(offset), ["conv", "part"], "left")
    return turns.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "words")


def rebuilt(turns):
    """Two tables: the conversations (conv, n, h, taken, length) and their turns (conv, depth, last, t1, t2, words).

    Conversation c begins with the first h turns of conversation c - c % 20, where h is
    crc32(c) % 4, and goes on with its own turns after its first h. The remainder has the sign of c.
    """
    turns = materialize(turns)
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % 4, "base": F.col("conv") - F.col("conv") % 20})
    convs = materialize(convs)
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("of_base"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.select("conv", "n", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = attach(turns, convs.select("conv", "n", "h", "taken", "length"), "conv", "n").where("pos > h")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    heads = turns.where("pos <= 3 AND conv % 20 = 0").select(F.col("conv").alias("base"), "pos", "t1", "t2", "words")
    lent = convs.where("taken > 0").join(heads, "base").where("pos <= taken").withColumn("depth", F.col("pos"))
    cols = ["conv", "depth", (F.col("depth") == F.col("length")).alias("last"), "t1", "t2", "words"]
    return convs, own.select(*cols).unionByName(lent.select(*cols))


def prefixes(turns):
    """(conv, depth, last, node, parent, words): the 128-bit name of the first `depth` turns.

    A name is the exclusive or of hashes of every turn with its depth, so it can be summed up in
    chunks of a conversation.
    """
    salted = [F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(9), "depth", "t1", "t2")]
    d = turns.select("conv", "depth", F.expr(f"(depth - 1) div {CHUNK}").alias("chunk"), "last", *[h.alias(f"x{i}") for i, h in enumerate(salted)], "words")
    d = materialize(d)
    sums = d.groupBy("conv", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"s{i}") for i in (0, 1)])
    earlier = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv", "chunk", *[F.bit_xor(f"s{i}").over(earlier).alias(f"s{i}") for i in (0, 1)])
    so_far = W.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({f"r{i}": F.bit_xor(f"x{i}").over(so_far) for i in (0, 1)}).join(sums, ["conv", "chunk"])
    name = [F.col(f"r{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0))) for i in (0, 1)]
    node = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(name)])
    parent = F.struct(*[c.bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i, c in enumerate(name)])
    return d.select("conv", "depth", "last", node.alias("node"), parent.alias("parent"), "words")


def list_digests(pairs):
    """(node, ends_sha256): the SHA-256 of every node's conversations, ascending, comma-joined.

    The lists are joined to rows of about PIECE bytes where the sorted rows lie; then one task
    per node takes these in order, and holds one of them at a time.
    """
    d = pairs.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    d = d.select("node.k0", "node.k1", "conv")

    def join(batches):
        key, first, ids, size, out = None, None, [], 0, []

        def packed():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["k0", "k1", "first", "ids"])

        for b in batches:
            for k0, k1, conv in zip(*[c.to_pylist() for c in b.columns]):
                if (k0, k1) != key or size > PIECE:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = (k0, k1), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) >= 1000:
                yield packed()
        if ids:
            out.append((*key, first, ",".join(ids)))
        if out:
            yield packed()

    def digest(batches):
        key, sha, out = None, None, []
        for b in batches:
            for k0, k1, ids in zip(*[c.to_pylist() for c in b.columns]):
                if (k0, k1) != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k0, k1), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["k0", "k1", "sha"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, sha.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names=["k0", "k1", "sha"])

    parts = d.mapInArrow(join, "k0 long, k1 long, first long, ids string")
    parts = parts.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first").select("k0", "k1", "ids")
    found = parts.mapInArrow(digest, "k0 long, k1 long, sha string")
    return found.select(F.struct("k0", "k1").alias("node"), F.col("sha").alias("ends_sha256"))


def prefix_trie(df, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per distinct sequence of first turns of the rebuilt conversations (see `rebuilt`).

    conv_id (smallest member), depth (0 for the root, of which all conversations are members),
    parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree, words of the last turn times members but one) and ends_sha256 (of the ids
    of the members that end here). Turns are ordered by turn (null first), then role and text;
    null roles and texts are empty, rows without a conversation are left out, repeated rows are
    turns of their own, other columns are ignored. An empty table gives no rows.
    """
    convs, turns = rebuilt(text_turns(df, conv_col, turn_col, role_col, text_col))
    keyed = materialize(prefixes(turns))
    zero = F.struct(F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("k1"))
    nodes = keyed.groupBy("node", "depth", "parent").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast(keyed.schema["parent"].dataType)
    root = root.select(zero.alias("node"), F.lit(0).cast("long").alias("depth"), none.alias("parent"), "conv", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = nodes.select(*root.columns).unionByName(root)
    nodes = materialize(nodes)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = keyed.where("last").select("node", "conv").unionByName(convs.where("length = 0").select(zero.alias("node"), "conv"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    out = attach(nodes.drop("n_children", "words"), parents.withColumnRenamed("n_children", "weight"), "parent", "weight")
    out = out.join(nodes.select("node", "n_children"), "node").join(totals, "node").join(list_digests(ends), "node", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


#: The same rows in DuckDB; a node is named by the list of its turns.
TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, count(*) AS n FROM t GROUP BY c),
crc AS {CRC_TABLE},
h AS (SELECT c, n, {crc_sql("list_transform(str_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM z, crc),
v AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN z b ON b.c = h.c - h.c % 20),
r AS (SELECT v.c, pos AS d, role, txt FROM v JOIN t ON t.c = v.c - v.c % 20 AND pos <= v.h
      UNION ALL SELECT v.c, pos - v.h + v.taken, role, txt FROM v JOIN t ON t.c = v.c AND pos > v.h),
k AS (SELECT c, d, md5(list(length(role) || ':' || role || txt) OVER (PARTITION BY c ORDER BY d)::VARCHAR) AS k,
      len(list_filter(regexp_split_to_array(txt, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
      d = max(d) OVER (PARTITION BY c) AS last FROM r
      UNION ALL SELECT v.c, 0, 'root', 0, NOT EXISTS (SELECT 1 FROM r WHERE r.c = v.c) FROM v),
n AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM k GROUP BY k, d),
p AS (SELECT n.*, up.k AS up FROM n LEFT JOIN k up ON up.c = n.c AND up.d = n.d - 1),
q AS (SELECT up AS k, count(*) AS n_children FROM p GROUP BY up),
s AS (SELECT k.k, count(*) FILTER (q.n_children IS NULL) AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
      FROM n JOIN k ON k.c = n.c AND k.d <= n.d LEFT JOIN q ON q.k = n.k GROUP BY k.k)
SELECT p.c AS conv_id, p.d AS depth, up.c AS parent_conv_id, p.n_convs, coalesce(q.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens, p.ends_sha256
FROM p LEFT JOIN n up ON up.k = p.up LEFT JOIN q ON q.k = p.k JOIN s ON s.k = p.k
"""
