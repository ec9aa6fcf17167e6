"""Repeated passages of 50 words or more, by suffix trees over prefix-partitioned suffixes."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from firn.llm.common import as_bytes, gram_hashes, pieces, word_hashes
from firn.session import materialize

WINDOW = 50
#: Words of the prefix that suffixes are partitioned by; longer where a prefix is too frequent.
PREFIX = 8
#: Suffixes of one short prefix that a subtree may hold; more go on with the longest prefix.
GROUP = 512
#: Suffixes a task builds subtrees for at once.
BLOCK = 8_000
#: Windows of one mask, one bit each.
BITS = 60
LAST = (1 << 63) - 1


def anchors(grams, span):
    """Positions of the smallest hash in every run of `span` hashes, the rightmost among equals.

    The choice depends on the run alone, so equal windows choose the same place in themselves.
    """
    n = len(grams)
    if n < span:
        return np.zeros(0, np.int64)
    value, place, width = grams, np.arange(n), 1
    def pick(v, p, k, m):
        a, b = v[:m], v[k : k + m]
        right = b <= a
        return np.where(right, b, a), np.where(right, p[k : k + m], p[:m])
    while width * 2 <= span:
        value, place = pick(value, place, width, len(value) - width)
        width *= 2
    if width < span:
        value, place = pick(value, place, span - width, n - span + 1)
    return np.unique(place)


def word_starts(data):
    """Hashes of the words of some bytes and the anchors of its windows, None if it has no window."""
    start, end, words = word_hashes(data)
    if len(words) < WINDOW:
        return None
    return start, end, words, anchors(gram_hashes(words, PREFIX), WINDOW - PREFIX + 1)


def _facts(docs):
    """Per row: id, doc, row, n_words, the words' SHA-256 and how often each prefix stands at an anchor."""

    def run(batches):
        for b in pieces(batches, "text"):
            n, sha, grams, counts = [], [], [], []
            for t in as_bytes(b, "text"):
                words = t.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                found = word_starts(t)
                g, c = (), ()
                if found is not None:
                    g, c = np.unique(gram_hashes(found[2], PREFIX)[found[3]].view(np.int64), return_counts=True)
                grams.append(g)
                counts.append(c)
            cols = [b.column(i) for i in range(3)]
            cols += [pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "doc", "row", "n_words", "sha", "grams", "counts"])

    return docs.mapInArrow(run, "id long, doc long, row long, n_words long, sha binary, grams array<long>, counts array<long>")


def _suffixes(docs):
    """The suffixes at the anchors named in `grams`, with the words before and after them in one window's reach.

    `grams` are the repeated prefixes of a text, `hot` those too frequent for one subtree. Those
    suffixes come as the windows around the anchor, each with 128 bits that stand for its whole
    prefix of 50 words. Equal windows of the few MB of texts a task reads together, a piece, are
    one row, with their number in the piece and the smallest and the largest doc. One row per
    text names the numbers and the starts of its windows.
    """
    reach = WINDOW - PREFIX

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for b in pieces(batches, "text"):
            rows, deep, low, high, texts = [[] for _ in range(6)], {}, [], [], [[] for _ in range(4)]
            for doc, key, grams, hot, t in zip(*(b.column(i).to_pylist() for i in range(4)), as_bytes(b, "text")):
                start, end, words, at = word_starts(t)
                g = gram_hashes(words, PREFIX).view(np.int64)
                at = at[np.isin(g[at], np.array(grams, np.int64))]
                often = np.isin(g[at], np.array(hot or [], np.int64))
                n = len(words)
                for a in at[~often].tolist():
                    lo, hi = max(0, a - reach), min(n, a + WINDOW)
                    for c, v in zip(rows, (doc, key, int(g[a]), a, a - lo, t[start[lo] : end[hi - 1]])):
                        c.append(v)
                if often.any():
                    first = (at[often][:, None] - np.arange(reach, -1, -1)).ravel()
                    first = np.unique(first[(first >= 0) & (first <= n - WINDOW)])
                    seen = []
                    for i in first.tolist():
                        d = hashlib.blake2b(b" ".join(t[start[i] : end[i + WINDOW - 1]].split()), digest_size=16).digest()
                        k = deep.setdefault(d, len(deep))
                        if k == len(low):
                            low.append(doc)
                            high.append(doc)
                        low[k], high[k] = min(low[k], doc), max(high[k], doc)
                        seen.append(k)
                    for c, v in zip(texts, (doc, key, seen, first)):
                        c.append(v)
            if n := len(rows[0]):
                yield _batch(n, **dict(zip(("doc", "row", "gram", "at", "before", "words"), rows)))
            if n := len(deep):
                yield _batch(n, doc=low, deep=list(deep), most=high, piece=[number] * n, window=range(n))
            if n := len(texts[0]):
                yield _batch(n, piece=[number] * n, **dict(zip(("doc", "row", "seen", "starts"), texts)))
            number += 1

    return docs.mapInArrow(run, "doc long, row long, gram long, at int, before int, words binary, deep binary, most long, piece long, window int, seen array<int>, starts array<int>")


_TYPES = {
    "doc": pa.int64(), "row": pa.int64(), "gram": pa.int64(), "at": pa.int32(), "before": pa.int32(), "words": pa.binary(), "deep": pa.binary(), "most": pa.int64(),
    "piece": pa.int64(), "window": pa.int32(), "seen": pa.list_(pa.int32()), "starts": pa.list_(pa.int32())}


def _batch(n, **columns):
    """A batch of n rows with the given columns; the others are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], names=list(_TYPES))


def tree_depths(m):
    """Sorted order of the rows of a word-number matrix and, per depth, the node every row hangs under.

    Sorted suffixes and the length of what neighbours share are the suffix tree: at depth d a
    new node begins where neighbours share fewer than d words. Row r of the result holds the
    node numbers at depth r, 0 to the width.
    """
    n, width = m.shape
    order = np.argsort(np.ascontiguousarray(m.astype(">u4")).view(np.dtype((np.void, 4 * width))).ravel(), kind="stable")
    s = m[order]
    shared = np.zeros(n, np.int64)
    if n > 1:
        same = np.logical_and.accumulate(s[1:] == s[:-1], axis=1)
        shared[1:] = same.sum(axis=1)
    nodes = np.empty((width + 1, n), np.int64)
    for d in range(width + 1):
        nodes[d, order] = np.cumsum(shared < d) if d else 0
    return nodes


def repeats(doc, before, words):
    """Which of the windows around each suffix's anchor also occur in a text with a smaller doc.

    A bit mask per suffix: bit o stands for the window that begins o words before the anchor.
    A window is a node at depth o of the tree of reversed words before the anchors and a node at
    depth 50 - o of the tree of the suffixes from the anchors on; both subtrees cover all
    prefixes of the block at once, for the suffix itself begins with its prefix.
    """
    n, reach = len(doc), WINDOW - PREFIX
    number = {}
    right, left = np.zeros((n, WINDOW), np.int64), np.zeros((n, reach), np.int64)
    for r, (b, w) in enumerate(zip(before, words)):
        ids = [number.setdefault(x, len(number) + 1) for x in w.split()]
        right[r, : len(ids) - b] = ids[b:]
        left[r, :b] = ids[:b][::-1]
    after, ahead = tree_depths(right), tree_depths(left)
    long = (right > 0).sum(axis=1)
    doc, before = np.asarray(doc, np.int64), np.asarray(before)
    mask = np.zeros(n, np.int64)
    for o in range(reach + 1):
        ok = np.flatnonzero((before >= o) & (long >= WINDOW - o))
        if len(ok) < 2:
            continue
        node = ahead[o, ok] * (n + 1) + after[WINDOW - o, ok]
        order = np.lexsort([doc[ok], node])
        first = np.concatenate([[True], node[order][1:] != node[order][:-1]])
        least = doc[ok][order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        hit = ok[order[doc[ok][order] > least]]
        mask[hit] |= np.int64(1) << np.int64(o)
    return mask


def _subtrees(rows):
    """(row, at, mask) for the suffixes of short prefixes; each task gets whole prefixes, one after the other."""

    def run(batches):
        held = []
        def solve(table):
            mask = repeats(table["doc"].to_pylist(), table["before"].to_pylist(), table["words"].to_pylist())
            hit = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([table["row"].combine_chunks().take(pa.array(hit)), table["at"].combine_chunks().take(pa.array(hit)), pa.array(mask[hit])], names=["row", "at", "mask"])
        count = 0
        for b in pieces(batches, "words"):
            held.append(b)
            count += b.num_rows
            if count < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            gram = table["gram"].to_numpy()
            change = np.flatnonzero(gram[1:] != gram[:-1])
            if not len(change):
                continue
            cut = int(change[-1]) + 1
            yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "row long, at int, mask long")


def candidates(heads):
    """(row, grams, hot): the prefixes of a text that other texts have at an anchor too.

    `hot` are those with too many suffixes for one subtree.
    """
    found = heads.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))
    found = materialize(found)
    often = found.groupBy("gram").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    often = materialize(often.select("gram", (F.col("n") > GROUP).alias("hot")))
    own = found.join(often, "gram").groupBy("row")
    return own.agg(F.collect_list("gram").alias("grams"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot"))


_SPOTS = pa.list_(pa.struct([("at", pa.int32()), ("mask", pa.int64())]))


def _marked(texts, hits):
    """(row, spots) for the texts of one piece, given the smallest doc of its repeated windows."""
    rows, spots = [], []
    if texts.num_rows and hits.num_rows:
        window, seen = hits["window"].to_numpy(), texts["seen"].combine_chunks()
        least = np.full(max(int(window.max()), seen.flatten().to_numpy().max()) + 1, LAST)
        least[window] = hits["least"].to_numpy()
        for row, doc, k, at in zip(texts["row"].to_pylist(), texts["doc"].to_pylist(), seen, texts["starts"].combine_chunks()):
            at = at.values.to_numpy().astype(np.int64)[least[k.values.to_numpy()] < doc]
            if len(at):
                block, where = np.unique(at // BITS, return_inverse=True)
                last = block * BITS + BITS - 1
                mask = np.zeros(len(block), np.int64)
                np.bitwise_or.at(mask, where, np.int64(1) << (last[where] - at))
                rows.append(row)
                spots.append([{"at": a, "mask": m} for a, m in zip(last.tolist(), mask.tolist())])
    return pa.table([pa.array(rows, pa.int64()), pa.array(spots, _SPOTS)], names=["row", "spots"])


def repeated_windows(lively):
    """(row, spots): per text the windows that also begin in a text with a smaller doc.

    `lively` has (doc, row, grams, hot, text). A spot is a position and a bit mask of the windows
    before it. Windows of frequent prefixes are looked up by their 50 words, once per piece of
    text, and what is found goes back to the piece as a whole.
    """
    rows = materialize(_suffixes(lively))
    spots = _subtrees(rows.where("gram IS NOT NULL").select("doc", "row", "gram", "at", "before", "words"))
    deep = rows.where("deep IS NOT NULL").select("doc", "most", "deep", "piece", "window")
    least = materialize(deep.groupBy("deep").agg(F.min("doc").alias("least"), F.max("most").alias("last")).where("least < last").select(F.col("deep").alias("node"), "least"))
    hits = deep.join(least, deep.deep == least.node).where("most > least").select("piece", "window", "least")
    texts = rows.where("seen IS NOT NULL").select(F.col("piece").alias("part"), "row", "doc", "seen", "starts")
    more = texts.groupBy("part").cogroup(hits.groupBy("piece")).applyInArrow(_marked, "row long, spots array<struct<at: int, mask: long>>")
    spots = spots.select("row", F.array(F.struct("at", "mask")).alias("spots"))
    return spots.union(more).groupBy("row").agg(F.flatten(F.collect_list("spots")).alias("spots"))


def covered(n, spots):
    """Which of n words lie in a marked window."""
    step = np.zeros(n + 1, np.int64)
    for s in spots:
        for o in range(s["mask"].bit_length()):
            if s["mask"] >> o & 1:
                step[s["at"] - o] += 1
                step[s["at"] - o + WINDOW] -= 1
    return np.cumsum(step)[:n] > 0


def _kept(marked):
    """(row, n_removed, kept) for texts with spots; the kept words are joined by one space."""

    def run(batches):
        for b in pieces(batches, "text"):
            gone, kept = [], []
            for text, spots in zip(as_bytes(b, "text"), b.column(2).to_pylist()):
                words = text.split()
                hit = covered(len(words), spots)
                gone.append(int(hit.sum()))
                kept.append(b" ".join([w for w, h in zip(words, hit.tolist()) if not h]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_removed", "kept"])

    return marked.mapInArrow(run, "row long, n_removed long, kept string")


def remove_repeats(df, id_col="doc_id", text_col="text"):
    """Per row: id, n_words, n_removed, kept_sha256; second, the kept words of the texts that lose some.

    A word goes if a window of 50 words around it also begins in a row with a smaller id. Rows
    with a null id count as larger than all others and equal to each other; rows of one id never
    cost each other words. Null and empty texts have no words. Repeated rows give equal results.
    Texts of the same words are looked up once: all but those of the smallest id lose every word
    that a window covers. Other columns are ignored; an empty table gives no rows. The second
    table, (row, n_removed, kept), has a row for each text that is partly repeated; its `row` is
    the 64-bit key of id and text.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select("id", F.coalesce("id", F.lit(LAST)).alias("doc"), F.xxhash64(F.lit(3), "id", "text").alias("row"), "text")
    facts = materialize(_facts(d))
    first = materialize(facts.groupBy("sha").agg(F.min(F.struct("doc", "row")).alias("head")).select(F.col("sha").alias("sha_"), F.col("head.doc").alias("least"), F.col("head.row").alias("top")))
    heads = facts.join(first, (facts.sha == first["sha_"]) & (facts.row == first.top)).where("n_words >= 50").select("row", "grams", "counts")
    near = materialize(candidates(heads).withColumnRenamed("row", "top"))
    lively = materialize(d.join(near, d.row == near.top).select("doc", "row", "grams", "hot", "text"))
    spots = materialize(repeated_windows(lively).withColumnRenamed("row", "top"))
    kept = materialize(_kept(lively.join(spots, lively.row == spots.top).select("row", "text", "spots")))
    fixed = kept.select(F.col("row").alias("at"), "n_removed", F.sha2("kept", 256).alias("kept_sha")).distinct()
    about = first.join(fixed, first.top == fixed["at"], "left").select("sha_", "least", "n_removed", "kept_sha")
    about = materialize(about)
    copy = (F.col("doc") > F.col("least")) & (F.col("n_words") >= WINDOW)
    out = facts.join(about, facts.sha == about["sha_"]).select(
        "id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"))
    return out, kept
