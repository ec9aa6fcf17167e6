"""Language ID, decontamination, near-duplicate vectors and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from firn.llm import contamination, graph, language, simhash

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = fx.odd_documents(spark)
    model = language.fit_language(docs)
    out = language.predict_language(fx.widened(docs), model)
    lang, score, accepted = out.columns[-3:]
    assert (lang, score, accepted) == ("lang_pred", "_score", "_accepted")
    for r in out.collect():
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert r[lang] in ({"en", "de"} if letter else {"und"}) and (letter or (r[score], r[accepted]) == (0, False))
    assert language.fit_language(fx.empty(spark)) is None
    assert language.predict_language(fx.empty(spark), model).count() == 0
    assert {r.lang_pred for r in language.predict_language(docs, None).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language(docs)
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzwkvj") for _ in range(9)) for _ in range(300))
    short = "Oh."
    got = model.predict([noise, short, docs.first().text])
    assert [g[2] for g in got] == [False, True, True]
    assert [g[2] for g in model.predict(["zxq wvk qqq zzz xj", "Пример текста", "qwrtzp lkjhg"])] == [False] * 3
    few = [r.text for r in docs.select("text").distinct().collect() if r.text and 0 < len(r.text) < 80]
    assert len(few) > 10 and np.mean([g[2] for g in model.predict(few)]) > 0.98


def test_without_labels_no_document_goes(spark):
    docs = fx.odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert fx.rows_of(language.keep_identified(docs)) == fx.rows_of(docs)
    assert language.keep_identified(fx.empty(spark)).count() == 0


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_smith_waterman():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        assert contamination.smith_waterman(a, b)[0] == slow_alignment(a, b)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [rng.choice(fx.WORDS)] if x < 2 * share / 3 else [w, "extra"] if x < share else [w]
    return out


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, fx.prose(rng, 40)) for i in range(20)] + [(20, None), (21, ""), (22, "two words"), (None, "w001 w002 w003")]
    docs, want = [], set()
    for d in range(200):
        text = fx.prose(rng, 120).split()
        if d % 4 == 0:
            i = d // 4 % 20
            at = rng.randrange(100)
            text[at:at] = edited(rng, items[i][1].split(), (d % 3) * 0.1)
            want.add((d, i))
        docs.append((d, " ".join(text).upper() if d % 8 == 0 else ", ".join(text)))
    for d in range(200, 320):  # one item in many documents is still found
        docs.append((d, fx.prose(rng, 9) + " " + items[0][1] + "."))
        want.add((d, 0))
    docs += [(400, None), (401, ""), (None, "nothing"), (402, "two words"), (402, "two words")]
    want |= {(402, 22)}
    it = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = contamination.contaminated_documents(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    clean = contamination.drop_contaminated(fx.widened(df), it)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert contamination.contaminated_documents(df, it.limit(0)).count() == 0
    assert contamination.contaminated_documents(df.limit(0), it).count() == 0
    assert contamination.drop_contaminated(df, it.limit(0)).count() == df.count()


VECTORS = "vec_id long, embedding array<float>, label int"


def slow_links(rows):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if o else None for r, o in zip(rows, ok)]
    n = len(rows)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    group = list(range(n))
    while True:
        new = [min([group[i], *(group[j] for j in near[i])]) for i in range(n)]
        if new == group:
            break
        group = new
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], len(x), least.get(g)) for r, x, g in zip(rows, near, group)), key=repr)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 16)) * 0.1, x[:1] + rng.normal(size=(80, 16)) * 0.05, x[:5]])
    rows = [(int(i), [float(v) for v in row], int(i % 3) if i < 300 else int((i - 300) % 60 % 3) if i < 360 else 0) for i, row in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [float("inf")] + [0.0] * 15, 1), (905, rows[0][1], None), (906, [], 0), (907, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[0], rows[0]]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "label")
    got = graph.near_vectors(df.selectExpr("*", "1 AS node", "2 AS m")).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr) == slow_links(rows)
    assert graph.near_vectors(df.limit(0)).count() == 0


def test_audit_is_not_hidden_by_a_hot_group(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=(1, 16)) + rng.normal(size=(150, 16)) * 0.02
    small = rng.normal(size=(20, 16)).repeat(2, axis=0) + rng.normal(size=(40, 16)) * 0.01
    x = np.concatenate([hot, small])
    m = [1000] + [1] * (len(x) - 1)
    rows = [(i, "0/16", [float(a) for a in v], m[i]) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "node long, space string, v array<double>, m long")
    schema = "node long, links long, hits long, root long"
    found = [(i, sum(m[:150]) - m[i], 149, 0) for i in range(150)]  # all of the hot group, none of the pairs
    assert graph.audit(classes, spark.createDataFrame(found, schema)) == pytest.approx(150 / 190)
    pairs = [(i, 1, 1, i) for i in range(150, 190)]
    assert graph.audit(classes, spark.createDataFrame(found + pairs, schema)) == 1.0


def test_vectors_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 60)
    monkeypatch.setattr(graph, "BLOCK", 90)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 24))
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, 24)) * 0.08, x[:1] + rng.normal(size=(150, 24)) * 0.05])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    want = {a: (b, c) for a, b, c in slow_links(rows)}
    got = graph.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.n_links <= want[r.id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(v[0] for v in want.values())
    assert sum(r.component_id == want[r.id][1] for r in got) >= 0.98 * len(got)


def test_many_cut_shards_make_one_flat_plan(spark, monkeypatch):
    """Cutting is a join with a table of large shards, so the plan does not grow with their number."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    rng = np.random.default_rng(9)
    centres = {"s": rng.normal(size=(600, 8))}
    rows = [(i, "s", 1, i, [float(v) for v in x]) for i, x in enumerate(np.repeat(centres["s"], 3, axis=0) + rng.normal(size=(1800, 8)) * 1e-3)]
    rows += [(5000 + i, "none", 1, 5000 + i, [float(i), 1.0]) for i in range(7)]  # a space without centres is cut, too
    classes = spark.createDataFrame(rows, "node long, space string, m long, least long, v array<double>")
    got = {r.node: r.n for r in graph.link_classes(classes, centres, 1).groupBy("node").agg(F.sum("hits").alias("n")).collect()}
    assert sum(got[i] >= 2 for i in range(1800)) > 1700
    x = np.array([[float(i), 1.0] for i in range(7)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [got[5000 + i] for i in range(7)] == ((x @ x.T >= graph.COSINE).sum(axis=1) - 1).tolist()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    last = p.STAGES[-1][1](spark, kept[-1], SF)
    n = [k.count() for k in kept]
    assert n[0] >= n[1] > 0.99 * n[0] and n[1] > n[2] > 0.8 * n[1] and n[2] > n[3] > 0.9 * n[2]
    assert last.count() == n[4] and last.columns[: len(docs.columns)] == docs.columns
    bad = {r.doc_id for r in contamination.contaminated_documents(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - bad
    assert fx.rows_of(p.run(spark, SF)) == fx.rows_of(last)


def test_pipeline_drops_fingerprint_groups(spark):
    """The near-dedup stage keeps the smallest id of every group that op2 links, and nothing else goes."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    groups = simhash.simhash_groups(docs).collect()
    assert sorted(r.doc_id for r in p.dedup(spark, docs, SF).collect()) == sorted({r.component_id for r in groups})
    odd = fx.widened(fx.odd_documents(spark))
    kept = p.dedup(spark, odd, SF)
    assert kept.columns == odd.columns and kept.where("doc_id = 900").count() == 0
    assert p.dedup(spark, fx.empty(spark), SF).count() == 0
