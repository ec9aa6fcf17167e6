"""Spelling variants: words one edit apart, found by K-d trees over their letter counts.

One edit changes few letter counts: a replaced letter adds one to a count and takes one from
another (L1 distance 2), an inserted letter adds one (L1 distance 1). So the words of each
length lie in a K-d tree of their letter counts, and a word looks only into the boxes within
that reach, among the words of its own length and of one letter more. What it meets there is
compared letter by letter.

The top of every tree is fitted on a sample and cuts the words of a length into cells; a task
builds the rest of the tree of a cell. A word travels to the other cells it can reach.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from firn.llm.common import as_list, pieces
from firn.llm.sql import CRC_TABLE, crc_sql
from firn.session import materialize

#: Code points that make up words: a to z, then U+00C0 to U+00FF.
LETTERS = 90
#: Words of a leaf inside a cell, and words of a cell, about.
LEAF, CELL = 16, 16_384
#: Sampled words per cell on which the tops of the trees are fitted, and in all.
FIT, SAMPLE = 32, 500_000
#: Words with the same letter counts beyond which pairs are found by wildcards instead.
CROWD = 256
#: Distinct words a task counts before it hands them on; bytes of text it splits at once.
HELD, SLICE = 300_000, 4 << 20
_PAIRS = 1 << 20
_ENDLESS = 1 << 30
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_OTHER = re.compile(rb"[^A-Za-z\xc0-\xff]")


def _slices(text):
    """Parts of a Latin-1 text of about SLICE bytes, cut between words."""
    lo = 0
    while len(text) - lo > SLICE:
        end = _OTHER.search(text, lo + SLICE)
        if not end:
            break
        yield text[lo : end.start()]
        lo = end.end()
    yield text[lo:]


def count_words(df, id_col="doc_id", text_col="text", least_length=5):
    """(word, n) over whole texts, added up per task.

    Runs of letters, A to Z lower-cased. Where 97 divides the crc32 of `<id>:<run>`, the run
    loses its code point crc32 % length. A null id is empty, a null text has no words.
    """
    given = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "word string, n long"

    def run(batches):
        held = Counter()

        def flush():
            items = [(w, n) for w, n in held.items() if n and len(w) >= least_length and len(w.decode()) >= least_length]
            held.clear()
            for lo in range(0, len(items), 50_000):
                part = items[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for b in pieces(batches, "text"):
            for key, text in zip(as_list(b, "id"), as_list(b, "text")):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for part in _slices(text.encode("latin-1", "replace")):
                    words = part.translate(_TABLE).decode("latin-1").encode().split()
                    held.update(words)
                    for w in [w for w in set(words) if not zlib.crc32(w, start) % 97]:
                        letters, n = w.decode(), words.count(w)
                        at = zlib.crc32(w, start) % len(letters)
                        held[w] -= n
                        held[(letters[:at] + letters[at + 1 :]).encode()] += n
                    if len(held) > HELD:
                        yield from flush()
        yield from flush()

    return given.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def codes(words):
    """The letters of words of one length as numbers below LETTERS, one row per word."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.where(raw < 128, raw - np.uint8(97), raw - np.uint8(166))


def counts(rows):
    """How often each letter occurs in each row."""
    flat = (np.arange(len(rows))[:, None] * LETTERS + rows).ravel()
    return np.bincount(flat, minlength=len(rows) * LETTERS).reshape(len(rows), LETTERS).astype(np.int32)


class Tree:
    """A K-d tree over letter counts. Inner nodes hold a letter, the count up to which words go
    left, and the bounds that the cuts above set on that letter; leaves hold a range of `order`."""

    def __init__(self, vectors, size):
        order = np.arange(len(vectors))
        nodes = []

        def add(lo, hi):
            nodes.append([-1, 0, 0, _ENDLESS, 0, 0, lo, hi])
            return len(nodes) - 1

        stack = [(add(0, len(order)), {}, {})]
        while stack:
            at, floor, ceiling = stack.pop()
            lo, hi = nodes[at][6:]
            if hi - lo <= size:
                continue
            own = order[lo:hi]
            x = vectors[own]
            cut = np.floor(x.mean(axis=0)).astype(np.int32)
            above = (x > cut).sum(axis=0)
            balance = np.minimum(above, hi - lo - above)
            k = int(balance.argmax())
            if not balance[k]:  # all alike
                continue
            right, t = x[:, k] > cut[k], int(cut[k])
            order[lo:hi] = np.concatenate([own[~right], own[right]])
            mid = lo + int((~right).sum())
            nodes[at][:6] = [k, t, floor.get(k, 0), ceiling.get(k, _ENDLESS), add(lo, mid), add(mid, hi)]
            stack += [(nodes[at][4], floor, {**ceiling, k: t}), (nodes[at][5], {**floor, k: t + 1}, ceiling)]
        self.order = order
        self.letter, self.cut, self.low, self.high, self.left, self.right, self.first, self.last = np.array(nodes, np.int64).T

    def reach(self, q, more, fewer):
        """(query, leaf) for the leaves whose box differs by at most `more` letters too many and `fewer` too few."""
        who, at = np.arange(len(q)), np.zeros(len(q), np.int64)
        gain, loss = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        found = []
        while len(who):
            inner = self.letter[at] >= 0
            found.append((who[~inner], at[~inner]))
            who, at, gain, loss = who[inner], at[inner], gain[inner], loss[inner]
            x, t = q[who, self.letter[at]], self.cut[at]
            up = gain + np.maximum(t + 1 - x, 0) - np.maximum(self.low[at] - x, 0)
            down = loss + np.maximum(x - t, 0) - np.maximum(x - self.high[at], 0)
            l, r = down <= fewer, up <= more
            who, at, gain, loss = (np.concatenate(p) for p in (
                (who[l], who[r]), (self.left[at[l]], self.right[at[r]]), (gain[l], up[r]), (down[l], loss[r])))
        return tuple(np.concatenate(p) for p in zip(*found))


def letter_bits(vectors):
    """64 bits per word, a letter sets one; one edit changes two of them at most."""
    bit = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)
    return np.bitwise_or.reduce(np.where(vectors > 0, bit, np.uint64(0)), axis=1)


def one_edit(a, b):
    """Whether rows of letter codes differ by exactly one edit; b is as long as a, or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    differs = np.concatenate([a != b[:, :n], np.ones((len(a), 1), bool)], axis=1)
    start = differs.argmax(axis=1)  # equal before
    after = np.concatenate([np.ones((len(a), 1), bool), a != b[:, 1:]], axis=1)
    stop = n - after[:, ::-1].argmax(axis=1)  # equal from here on, in a
    return stop <= start


class Cell:
    """The words of one length in one cell, with the best near word each has met so far."""

    def __init__(self, words, n):
        self.words, self.n = words, n
        self.codes = codes(words)
        vectors = counts(self.codes)
        self.bits = letter_bits(vectors)
        self.tree = Tree(vectors, LEAF)
        self.vectors = vectors
        self.near = np.zeros(len(words), np.int64)
        self.best = [None] * len(words)
        self.wild = {}

    def pairs(self, q, vectors, bits):
        """(query, member) that are one edit apart, in blocks; all queries are of one length."""
        same = q.shape[1] == self.codes.shape[1]
        who, leaf = self.tree.reach(vectors, 1, int(same))
        size = self.tree.last[leaf] - self.tree.first[leaf]
        for at in np.unique(leaf[size > CROWD]):
            yield self._wildcards(int(at), who[leaf == at], q, same)
        who, leaf, size = (x[size <= CROWD] for x in (who, leaf, size))
        block = max(1, min(_PAIRS, (64 << 20) // q.shape[1]))
        part = np.cumsum(size) // block
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(who)]
        for lo, hi in zip(cuts, cuts[1:]):
            s = size[lo:hi]
            of = np.repeat(who[lo:hi], s)
            place = np.arange(len(of)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.tree.first[leaf[lo:hi]], s)
            member = self.tree.order[place]
            close = np.bitwise_count(bits[of] ^ self.bits[member]) <= 2
            of, member = of[close], member[close]
            ok = one_edit(q[of], self.codes[member])
            yield of[ok], member[ok]

    def _wildcards(self, leaf, who, q, same):
        """Pairs of a crowded leaf: both words give the same hash once one letter is left out."""
        members = self.tree.order[self.tree.first[leaf] : self.tree.last[leaf]]
        if (leaf, same) not in self.wild:
            keys = _without_one(self.codes[members], same)
            order = np.argsort(keys.ravel(), kind="stable")
            self.wild[leaf, same] = keys.ravel()[order], order // keys.shape[1]
        keys, rows = self.wild[leaf, same]
        own = _without_one(q[who], True) if same else _whole(q[who])[:, None]
        lo, hi = np.searchsorted(keys, own.ravel(), "left"), np.searchsorted(keys, own.ravel(), "right")
        of = np.repeat(np.repeat(np.arange(len(who)), own.shape[1]), hi - lo)
        place = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        both = np.unique(np.stack([who[of], members[rows[place]]]), axis=1)
        ok = one_edit(q[both[0]], self.codes[both[1]])
        return both[0][ok], both[1][ok]

    def meet(self, of, n, word, member):
        """Take the near words of the members: `of` counts into the lists n and word."""
        np.add.at(self.near, member, 1)
        top = _best(member, of, n, word)
        for m, o in top:
            new = (-int(n[o]), word[o])
            if self.best[m] is None or new < self.best[m]:
                self.best[m] = new


def _powers(k):
    p = np.full(k + 1, 0x9E3779B97F4A7C15, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=np.uint64)


def _whole(rows):
    with np.errstate(over="ignore"):
        return ((rows.astype(np.uint64) + np.uint64(1)) * _powers(rows.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _without_one(rows, keep_place):
    """For every place the hash of the row with that letter left open, or taken out."""
    k = rows.shape[1]
    power = _powers(k)
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64(1)
        if keep_place:
            term = x * power[:-1]
            return term.sum(axis=1, dtype=np.uint64)[:, None] - term + (np.arange(k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
        before = np.cumsum(x * power[:-1], axis=1, dtype=np.uint64) - x * power[:-1]
        shifted = x[:, 1:] * power[: k - 1]
        after = np.zeros_like(x)
        after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        return before + after


def _best(group, of, n, word):
    """(group, item) with the largest n, then the smallest word, for every group."""
    rank = np.empty(len(word), np.int64)
    rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
    order = np.lexsort((rank[of], -n[of], group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return list(zip(g[first].tolist(), of[order][first].tolist()))


def _rows(words, near, best):
    """One result batch: how many near words were met, and the best of them."""
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def fit_tops(vocab):
    """{length: Tree} for the lengths with more than CELL words, fitted on FIT words per cell.

    `vocab` has word, n and length. At most about SAMPLE words come to the driver.
    """
    sizes = {r.length: r["count"] for r in vocab.groupBy("length").count().where(F.col("count") > CELL).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    share = min(FIT / CELL, SAMPLE / total)
    picked = vocab.where(F.col("length").isin(*sizes)).where(F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    by_length = {}
    for r in picked.select("word", "length").collect():
        by_length.setdefault(r.length, []).append(r.word)
    return {k: Tree(counts(codes(sorted(w))), FIT) for k, w in by_length.items()}


def dealt(vocab, tops):
    """(length, cell, kind, word, n): every word in its own cell (kind 0), as a visitor of later
    cells of its length (kind 1), and of the cells with one letter more (kind 2)."""
    lengths = {r.length for r in vocab.select("length").distinct().collect()}

    def run(batches):
        for b in batches:
            size = b.column(2).to_numpy()
            for k in np.unique(size).tolist():
                words = b.column(0).take(pa.array(np.flatnonzero(size == k))).to_pylist()
                n = b.column(1).to_numpy()[size == k]
                vectors = counts(codes(words))
                own = np.zeros(len(words), np.int64)
                parts = []
                if k in tops:
                    who, own_leaf = tops[k].reach(vectors, 0, 0)
                    own[who] = own_leaf
                    who, leaf = tops[k].reach(vectors, 1, 1)
                    later = leaf > own[who]
                    parts.append((k, who[later], leaf[later], 1))
                if k + 1 in tops:
                    parts.append((k + 1, *tops[k + 1].reach(vectors, 1, 0), 2))
                elif k + 1 in lengths:
                    parts.append((k + 1, np.arange(len(words)), own * 0, 2))
                for at, who, cell, kind in [(k, np.arange(len(words)), own, 0), *parts]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), at, np.int64)), pa.array(cell), pa.array(np.full(len(who), kind, np.int32)), pa.array([words[i] for i in who.tolist()], pa.string()), pa.array(n[who])],
                        names=["length", "cell", "kind", "word", "n"])

    return vocab.select("word", "n", "length").mapInArrow(run, "length long, cell long, kind int, word string, n long")


def search(batches):
    """(word, n_near, best_n, best) from rows sorted by length, cell and kind; members come first."""
    key, words, n, cell = None, [], [], None

    def ready():
        c = Cell(words, np.array(n, np.int64))
        for lo in range(0, len(words), 4096):
            for of, member in c.pairs(c.codes[lo : lo + 4096], c.vectors[lo : lo + 4096], c.bits[lo : lo + 4096]):
                c.meet(of + lo, c.n, c.words, member)
        return c

    def done(c):
        met = np.flatnonzero(c.near).tolist()
        return _rows([c.words[i] for i in met], c.near[met], [c.best[i] for i in met])

    for b in batches:
        length, at, kind = (b.column(i).to_numpy() for i in range(3))
        change = np.flatnonzero((np.diff(length) != 0) | (np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
            if lo == hi:
                continue
            here = (int(length[lo]), int(at[lo]))
            if here != key:
                if words:
                    yield done(cell or ready())
                key, words, n, cell = here, [], [], None
            own, own_n = b.column(3).slice(lo, hi - lo).to_pylist(), b.column(4).slice(lo, hi - lo).to_numpy()
            if kind[lo] == 0:
                words += own
                n += own_n.tolist()
                continue
            if not words:  # nobody lives in this cell
                continue
            cell = cell or ready()
            for i in range(0, len(own), 4096):
                visitor, visitor_n = own[i : i + 4096], own_n[i : i + 4096]
                q = codes(visitor)
                vectors = counts(q)
                near, best = np.zeros(len(visitor), np.int64), [None] * len(visitor)
                for of, member in cell.pairs(q, vectors, letter_bits(vectors)):
                    cell.meet(of, visitor_n, visitor, member)
                    np.add.at(near, of, 1)
                    for v, m in _best(of, member, cell.n, cell.words):
                        new = (-int(cell.n[m]), cell.words[m])
                        if best[v] is None or new < best[v]:
                            best[v] = new
                met = np.flatnonzero(near).tolist()
                if met:
                    yield _rows([visitor[j] for j in met], near[met], [best[j] for j in met])
    if words:
        yield done(cell or ready())


def near_words(vocab):
    """(word, n_near, best_n, best): of every word with near words, their number and the most frequent one."""
    rows = dealt(vocab, fit_tops(vocab)).repartition("length", "cell").sortWithinPartitions("length", "cell", "kind", "word")
    met = rows.mapInArrow(search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("best_n"), "best"))
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return best.select("word", "n_near", (-F.col("first.best_n")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms, rounds=64):
    """(word, form, root, ...): forms are followed to the last, twice as far in every round.

    A form is at least twice as frequent as its word, so there are no cycles. Words that have
    arrived stay in the table, since others may come by them in later rounds.
    """
    cols = forms.columns
    alone = forms.where("form IS NULL").withColumn("root", F.col("word"))
    moving = materialize(forms.where("form IS NOT NULL").withColumn("root", F.col("form")))
    for _ in range(rounds):
        step = moving.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = materialize(moving.join(step, moving.root == step["at"], "left").drop("at"))
        moving = moved.select(*cols, F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return alone.unionByName(moving)
    raise RuntimeError(f"the forms did not end in {rounds} rounds")


def spelling_groups(df, id_col="doc_id", text_col="text", least_length=5, least_count=3):
    """(word, form, root, n, n_near, form_n) per word of at least so many code points and occurrences.

    See `count_words` for what a word is. Words are near if they differ by one inserted, deleted
    or replaced code point. The form is the near word with the largest n (ties: the smallest)
    if that is at least twice the word's n, else null; the root is the last of the forms, the
    word itself without one. Null ids are empty, null and empty texts have no words, repeated
    rows count again, other columns are ignored. An empty table gives no rows.
    """
    vocab = count_words(df, id_col, text_col, least_length).where(F.col("n") >= least_count)
    vocab = materialize(vocab.select("word", "n", F.char_length("word").cast("long").alias("length")))
    near = vocab.join(near_words(vocab), "word", "left")
    strong = F.col("best_n") >= 2 * F.col("n")
    forms = near.select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n"))
    return roots(materialize(forms)).select("word", "form", "root", "n", "n_near", "form_n")


#: The same rows in DuckDB: pairs meet where both words lose a letter.
SPELLING_SQL = f"""
WITH RECURSIVE crc AS {CRC_TABLE},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
told AS (SELECT w, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x, count(*) AS c FROM runs GROUP BY ALL),
summed AS (SELECT w, c, {crc_sql("list_transform(range(1, (length(x) // 2) + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)")} AS h FROM told, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, c FROM summed),
words AS (SELECT w, sum(c)::BIGINT AS n FROM spelt WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
less AS (SELECT w, n, i, left(w, i::INT) || substr(w, i::INT + 2) AS d FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
near AS (SELECT a.w, b.w AS v, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
         UNION SELECT less.w, words.w, words.n FROM less JOIN words ON less.d = words.w
         UNION SELECT words.w, less.w, less.n FROM less JOIN words ON less.d = words.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS n, min_by(v, (-n, v)) AS v FROM near GROUP BY w),
forms AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN v END AS form,
          CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS at, form AS next FROM forms
         UNION ALL SELECT walk.w, forms.w, forms.form FROM walk JOIN forms ON forms.w = walk.next)
SELECT forms.w AS word, form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk ON walk.w = forms.w AND walk.next IS NULL
"""
