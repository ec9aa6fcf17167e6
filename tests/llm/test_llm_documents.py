"""Operators on documents against brute force, on tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import fixtures as fx
from firn.llm import lm, mixing, pii, quality, sharding, simhash, substrings
from firn.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return fx.odd_documents(spark).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]


def lower(ws):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]


def fold(n, near):
    group = list(range(n))
    while True:
        new = [min([group[i], *(group[j] for j in near(i))]) for i in range(n)]
        if new == group:
            return group
        group = new


def slow_fingerprint(text):
    w = lower(words(text))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, local):
    got = sorted(((r.id if r.id is not None else -1), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(docs).collect())
    fp = [slow_fingerprint(t) for _, t in local]
    group = fold(len(fp), lambda i: [j for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for (i, _), g in zip(local, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert got == sorted(((i if i is not None else -1), f, least.get(g)) for (i, _), f, g in zip(local, fp, group))


def test_simhash_links_every_pair_of_two_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            i, j = rng.integers(0, 64, 2)
            fps.add(b ^ (1 << int(i)) ^ (1 << int(j)) * int(rng.integers(0, 2)))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    group = fold(len(fps), lambda i: [j for j in range(len(fps)) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2])
    for i, f in enumerate(fps):
        assert got.get(f, f) == fps[group[i]]


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = simhash.simhash_groups(docs).collect()
    rows = kept.collect()
    assert len(rows) == len({slow_fingerprint_group(r, groups) for r in groups})
    assert {r.doc_id for r in rows} <= {r.id for r in groups}


def slow_fingerprint_group(row, groups):
    return row.component_id if row.component_id is not None else ("none", row.fp)


@pytest.mark.parametrize("group", [1, 512])
def test_substrings(docs, local, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    d = [(i if i is not None else 1 << 62, i, words(t)) for i, t in local]
    first = {}
    for key, _, w in d:
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            first[s] = min(first.get(s, key), key)
    want = []
    for key, i, w in d:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    out, kept = substrings.remove_repeats(docs)
    assert fx.rows_of(out) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 300 and kept.count() > 0


@pytest.mark.parametrize("group", [1, 512])
def test_frequent_prefixes_take_the_longest_prefix(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    d = fx.odd_documents(spark, 4)
    assert fx.rows_of(substrings.remove_repeats(d)[0]) == fx.rows_of(substrings.remove_repeats(fx.widened(d).repartition(5))[0])


def slow_plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub(r"[^0-9]", "", m[0])
        odd = sum(int(c) for c in g[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in g[-2::-2])
        if 16 <= len(g) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_plain_personal_data(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789.+-@ ()aZ_%\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["pay 4111 1111 1111 1111 or +49 (176) 555-0123 from 10.0.0.255 to a.b@c-d.org", None, "", "@" * 500, "1" * 3000, "1." * 2000]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        base = slow_plain(texts[r.id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]


@pytest.mark.parametrize("text, kind, part", [
    ("mail john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
    ("or john at example dot com.", "email", "john at example dot com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("è jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("john@exam​ple.com", "email", "john@exam​ple.com"),
    ("call plus four nine one seven six five five five zero one two", "phone", "plus four nine one seven six five five five zero one two"),
    ("card " + "four " + "one " * 15 + "ok", "card", "four " + "one " * 14 + "one"),
    ("at 10 dot 0 dot 0 dot 7 now", "ip", "10 dot 0 dot 0 dot 7"),
    ("neun zwei dot one dot one dot one", "ip", "neun zwei dot one dot one dot one"),
])
def test_disguised_personal_data(text, kind, part):
    base, every = pii.personal_spans(text)
    assert base == [] and [(pii.KINDS[k], text[s:e]) for k, s, e in every] == [(kind, part)]


@pytest.mark.parametrize("more", ["", " the point"])
@pytest.mark.parametrize("text, kind, part", [
    ("write to john.doe at example.com", "email", "john.doe at example.com"),
    ("call plus 49 176 5550123", "phone", "plus 49 176 5550123"),
    ("call PLUS-49 176 5550123", "phone", "PLUS-49 176 5550123"),
])
def test_disguises_need_no_other_sign(text, kind, part, more):
    base, every = pii.personal_spans(text + more)
    assert base == [] and [(pii.KINDS[k], text[s:e]) for k, s, e in every] == [(kind, part)]


@pytest.mark.parametrize("text, kind, plain, whole", [
    ("mail jоhn@example.com", "email", "hn@example.com", "jоhn@example.com"),
    ("mail jo\u00adhn@example.com", "email", "hn@example.com", "jo\u00adhn@example.com"),
    ("call +49 176 555 01 two three", "phone", "+49 176 555 01", "+49 176 555 01 two three"),
])
def test_whole_identifiers_beside_their_plain_parts(text, kind, plain, whole):
    base, every = pii.personal_spans(text)
    named = lambda spans: [(pii.KINDS[k], text[s:e]) for k, s, e in spans]
    assert named(base) == [(kind, plain)] and set(named(every)) == {(kind, plain), (kind, whole)} and len(every) == 2


@pytest.mark.parametrize("text", ["look at the dot now", "one or two at a time", "Привет, мир", "é at the point", "un, deux, trois", "it was at home. dot com boom"])
def test_clean_texts_stay_clean(text):
    assert pii.personal_spans(text) == ([], [])


def test_mixing_is_a_permutation_of_poisson_copies(docs):
    out = mixing.replicate(docs.drop("n_chars"), extra=True).collect()
    assert sorted(r.position for r in out) == list(range(len(out)))
    keys = [r.shuffle_key for r in sorted(out, key=lambda r: r.position)]
    assert keys == sorted(keys)
    assert all(1 <= r.copy <= r.copies for r in out)
    wide = fx.widened(docs)
    assert mixing.replicate(wide).columns == wide.columns


def test_mixing_meets_target_weights(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CAST(id AS string) AS text", "IF(id % 6 = 0, 'rare', 'common') AS source")
    weights = spark.createDataFrame([("rare", 3.0), ("common", 1.0)], "source string, weight double")
    n = Counter(r.source for r in mixing.replicate(df, target=12000, weights=weights).collect())
    assert abs(n["rare"] - 9000) < 5 * math.sqrt(9000) and abs(n["common"] - 3000) < 5 * math.sqrt(3000)
    one = spark.createDataFrame([("rare", 1.0)], "source string, weight double")
    out = Counter(r.doc_id for r in mixing.replicate(df.where("source = 'rare'"), target=100_000, weights=one).collect())
    assert abs(sum(out.values()) - 100_000) < 2000 and len(out) == 1000


def test_sharding_is_a_permutation(docs, spark):
    wide = fx.widened(docs)
    out = sharding.shuffle_shards(wide, shards=7)
    shard, slot = out.columns[-2:]
    rows = out.collect()
    per = defaultdict(list)
    for r in rows:
        per[r[shard]].append(r[slot])
    sizes = [len(v) for v in per.values()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert Counter(tuple(r)[: len(wide.columns)] for r in rows) == Counter(map(tuple, wide.collect()))
    again = sharding.shuffle_shards(wide.repartition(3), shards=7).select("doc_id", "text", shard, slot)
    assert fx.rows_of(again) == fx.rows_of(out.select("doc_id", "text", shard, slot))


def test_hot_rows_are_dealt_singly(spark):
    df = spark.createDataFrame([(1, "same")] * 400 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    rows = sharding.shuffle_shards(df, shards=5, hot=5_000, buckets=40).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(map(tuple, df.collect()))
    same = Counter(r.shard for r in rows if r.text == "same")
    assert sorted(Counter(r.shard for r in rows).values()) == [100] * 5 and min(same.values()) > 50


def test_few_long_copies_are_dealt_singly(spark):
    """What counts is the bytes of the copies: 60 long ones are dealt singly, 60 short ones share a bucket."""
    df = spark.createDataFrame([(1, "x" * 5_000)] * 60 + [(2, "y")] * 60 + [(3, "z" * 90_000)], "doc_id long, text string")
    names = ("_a", "_b", "_copy")
    d, n, size = sharding.scattered(df, "doc_id", "text", 11, 50_000, names)
    copies = Counter((r.doc_id, r._copy) for r in d.collect())
    assert copies == Counter([(1, i) for i in range(1, 61)] + [(2, 0)] * 60 + [(3, 0)]) and n == 121
    assert size == 60 * 5_008 + 60 * 9 + 90_008


def test_sharding_digest(docs):
    rows = sharding.sharded_documents(docs, shards=5).collect()
    text = lambda r: (r.text or "").encode()
    want = Counter((r.doc_id, len(text(r)) + 8, zlib.crc32(text(r)), "rows", None) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows) == want
    assert sharding.sharded_documents(docs.limit(0), shards=5).count() == 0


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(2)
    n = Counter(tuple(sharding.fisher_yates(4, rng).tolist()) for _ in range(24_000))
    assert len(n) == 24 and max(abs(x - 1000) for x in n.values()) < 160


def test_lm_counts_and_probabilities(docs, local):
    c = Counter()
    for i, t in local:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(lower(words(t)))
            c[b""] += 1
    total, kinds = sum(c.values()), len(c)
    for few in (dict(), dict(known=20, lookup=50)):
        rows = defaultdict(list)
        for r in lm.score_texts(docs, **few).collect():
            rows[r.id].append(r)
        want = defaultdict(list)
        for i, t in local:
            want[i].append(lower(words(t)) + [b""])
        assert rows.keys() == want.keys()
        for i in rows:
            base = sorted(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws) for ws in want[i])
            assert np.allclose(sorted(r.base_score for r in rows[i]), base, rtol=1e-9)
            assert sorted((r.n_tokens, r.n_known) for r in rows[i]) == sorted((len(ws), sum(c[w] > 0 for w in ws)) for ws in want[i])
            assert all(r.train_tokens == total and r.score < 0 for r in rows[i])


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    u = rng.random(50)
    m = lm.LogBilinear(u / u.sum(), 8)
    z = m.log_normaliser(7)
    s = (m.r[7] @ m.c[0] + m.r[9] @ m.c[1]) @ m.q.T + m.b
    assert abs(np.exp(s - z[9]).sum() - 1) < 1e-5


def test_lm_learns_what_follows():
    ids = np.tile([2, 3, 4, 5], 30_000)
    u = np.full(6, 1 / 6)
    m = lm.LogBilinear(u, 8)
    before, last, word = lm.contexts(ids)
    m.train(([x[i : i + 2000] for x in (before, last, word)] for i in range(0, len(ids), 2000)), u, 1, rate=0.3)
    s = (m.r[2] @ m.c[0] + m.r[3] @ m.c[1]) @ m.q.T + m.b
    assert s.argmax() == 4 and np.exp(s[4] - m.log_normaliser(2)[3]) > 0.5


def test_line_field_marginals():
    rng = np.random.default_rng(4)
    f = quality.LineField(3)
    f.step, f.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    counts = np.array([1, 4, 2, 4])
    e = rng.normal(size=(counts.sum(), 2))
    p, z, _ = quality.forward_backward(e, counts, f.step, f.first)
    at = 0
    for n, total in zip(counts, z):
        part = e[at : at + n]
        score = {}
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            score[tuple(y)] = f.first[y[0]] + sum(part[i, v] for i, v in enumerate(y)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))
        norm = math.log(sum(math.exp(s) for s in score.values()))
        assert abs(norm - total) < 1e-9
        for i in range(n):
            assert abs(sum(math.exp(s - norm) for y, s in score.items() if y[i]) - p[at + i, 1]) < 1e-9
        at += n


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model)
    rows = got.join(labels, got.id == labels.doc_id).where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(docs, labels) is None
    rows = quality.score_quality(fx.widened(docs), None).collect()
    assert len(rows) == docs.count() and all(r.score == 0.5 for r in rows)
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality")
    rows = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(spark):
    none = fx.empty(spark)
    assert simhash.simhash_groups(none).count() == simhash.drop_near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none)[0].count() == pii.personal_data(none).count() == 0
    assert mixing.replicate(none).count() == sharding.shuffle_shards(none).count() == 0
    assert lm.score_texts(none).count() == quality.score_quality(none, None).count() == 0
