"""Spelling variants, exact dedup and the prefix trie against brute force, on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import fixtures as fx
from firn.llm import conversations, exact, spelling, trees

UPPER = {c: c + 32 for c in range(65, 91)}


# --- exact dedup ---------------------------------------------------------------------------------


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def slow_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        stays = known[0] if known else None
        kept = [True] + [False] * (len(ids) - 1)
        ordered = known + [None] * (len(ids) - len(known))
        out += [(i, stays, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(ordered, kept)]
    return sorted(out, key=repr)


def exact_rows():
    rng = random.Random(3)
    same_start = "s" * 300  # equal length and prefix, different ends
    texts = [fx.prose(rng, n) for n in (3, 3, 40, 200)] + [same_start + "a", same_start + "b", same_start + "a"]
    texts += ["a  b", "a b", "a\tb", "a b", " a b", "", None, " ", "\n", "x" * 50_000, "x" * 50_000]
    texts += ["hot copy"] * 300
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (None, "a b"), (None, "nobody"), (None, "nobody"), (None, None)]


def test_exact_dedup(spark):
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_groups(fx.widened(df).withColumn("alive", exact.F.lit(1)), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_exact(rows)
    full = {r.id: r.text_sha256 for r in exact.exact_groups(df).where("group_size > 1").collect()}
    assert all(full.values())


def test_exact_dedup_keeps_whole_rows(spark):
    rows = exact_rows()
    df = fx.widened(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    want = [(i, h) for i, _, _, k, h in slow_exact(rows) if k]
    got = [(r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_with_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(exact, "PLACES", 1)
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in exact.exact_groups(df, digest=True).collect()), key=repr) == slow_exact(rows)


def test_exact_dedup_is_native(spark):
    df = spark.createDataFrame(exact_rows(), "doc_id long, text string")
    plan = exact.exact_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- spelling variants ---------------------------------------------------------------------------


def slow_words(rows, least_length=5, least_count=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(words):
    meets = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and near(w, v)] for w in words}
    form = {}
    for w, vs in meets.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), words[w], len(meets[w]), words[form[w]] if form[w] else None) for w in words)


def worded(rng, alphabet, length, count):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(*length))) for _ in range(count)]


def spelling_rows(seed=5):
    rng = random.Random(seed)
    base = worded(rng, "abcdeé÷ÿ", (5, 9), 150) + worded(rng, "ab", (5, 8), 60) + ["x" * 400, "x" * 401, "x" * 399 + "y"]
    rows = []
    for i in range(150):
        words = []
        for w in rng.choices(base, k=30):
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "d" + w[at + 1 :]])
            words.append(w.upper() if w.isascii() and rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "漢", "İ"]).join(words)))
    return rows + [(7, None), (None, "nobody nobody nobody nobodi"), (9, ""), (10, "\n\t"), rows[3], rows[3]]


@pytest.mark.parametrize("cell,leaf,crowd", [(16_384, 16, 256), (40, 4, 256), (60, 2, 3)])
def test_spelling(spark, monkeypatch, cell, leaf, crowd):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "SLICE", 300)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = spelling_rows()
    df = fx.widened(spark.createDataFrame(rows, "doc_id long, text string"))
    got = spelling.spelling_groups(df).collect()
    want = slow_groups(slow_words(rows))
    assert len(want) > 200 and any(r[2] != r[1] and r[1] for r in want)
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("steps", [1, 5, 7, 21])
def test_roots_of_long_chains(spark, steps):
    """Words whose way leads by words that arrived rounds ago."""
    rows = [(f"w{i}", f"w{i + 1}" if i < steps else None) for i in range(steps + 1)]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert sorted((r.word, r.form, r.root) for r in got) == sorted((w, f, f"w{steps}") for w, f in rows)


def test_spelling_chain(spark):
    words = ["abcdefghijkl"[: 5 + i] for i in range(6)]  # each is near the next, which is twice as frequent
    rows = [(i, " ".join(w for k, w in enumerate(words) if i < 4 << k)) for i in range(128)]
    got = spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == slow_groups(slow_words(rows))



def test_spelling_of_odd_tables(spark):
    empty = spelling.spelling_groups(fx.empty(spark))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    rows = [(r.doc_id, r.text) for r in fx.odd_documents(spark).collect()]
    got = spelling.spelling_groups(fx.odd_documents(spark)).collect()
    assert sorted(tuple(r) for r in got) == slow_groups(slow_words(rows))


def test_boxes_lose_no_pair():
    """The range search over the letter counts meets every pair that is one edit apart."""
    rng = random.Random(2)
    words = sorted(set(worded(rng, "abcd", (6, 8), 600)))
    by_length = {k: [w for w in words if len(w) == k] for k in (6, 7)}
    cells = {k: spelling.Cell(w, np.ones(len(w), np.int64)) for k, w in by_length.items()}
    for a, b in ((6, 6), (6, 7)):
        q, c = cells[a], cells[b]
        got = {(by_length[a][i], by_length[b][j]) for who, member in c.pairs(q.codes, q.vectors, q.bits) for i, j in zip(who.tolist(), member.tolist())}
        assert got == {(v, w) for v in by_length[a] for w in by_length[b] if v != w and near(v, w)}


# --- prefix trie ---------------------------------------------------------------------------------


def slow_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(3, 130):
        if c % 11 == 0:
            continue
        n = rng.choice([1, 2, 3, 5])
        start = rng.choice(["hello there", "a b c", "", None])
        for t in range(n):
            text = start if t == 0 else rng.choice(["yes", "no way", "tell me\tmore  please", None])
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]) if t else "user", text))
    rows += [(140, t, "user", f"turn {t % 3}") for t in range(40)] + [(141, t, "user", f"turn {t % 3}") for t in range(45)]
    rows += [(150 + i, t, "user", "very common") for i in range(60) for t in range(2)]
    rows += [(300, None, "user", "null turn"), (300, None, "system", "null turn"), (300, 0, "user", "x"), (300, 0, "user", "x"), (None, 0, "user", "lost"), (-7, 0, "user", "below zero"), (-20, 0, "user", "hello there")]
    rng.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk,piece", [(4096, 1 << 16), (4, 20)])
def test_prefix_trie(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = conversation_rows()
    df = spark.createDataFrame(rows, CONV).withColumn("node", conversations.F.lit("own")).withColumn("depth", conversations.F.lit(1))
    got = conversations.prefix_trie(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert conversations.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert conversations.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0


def test_subtree_totals_of_chains_and_bushes(spark):
    rng = random.Random(4)
    parent = {0: None, **{i: i - 1 for i in range(1, 120)}}  # a long chain
    parent |= {i: rng.randrange(i) for i in range(120, 200)}
    parent |= {i: 7 for i in range(200, 400)}  # a bush
    parent |= {1000: None, 1001: 1000}
    value = {n: rng.randrange(10) for n in parent}
    df = spark.createDataFrame([(n, p, value[n], 1) for n, p in parent.items()], "node long, parent long, value long, one long")
    want = {n: [0, 0] for n in parent}
    for n in parent:
        at = n
        while at is not None:
            want[at][0] += value[n]
            want[at][1] += 1
            at = parent[at]
    got = trees.subtree_totals(df, ["value", "one"]).collect()
    assert {r.node: [r.value, r.one] for r in got} == want and len(got) == len(parent)
    assert trees.subtree_totals(df.limit(0), ["value", "one"]).count() == 0
