"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a word from the two words before it: their vectors, each times a matrix of
its place, add up to the expected vector of the next word; its product with a word's vector
plus a bias is the word's score. It knows the most frequent words, the end of a text and one
class for all other words, whose members follow their smoothed counts.
"""

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from firn.llm.common import as_bytes, held_out, pieces, remainder, row_key
from firn.session import materialize

#: Words of the model, with the end of a text and the class of all others.
KNOWN = 1024
DIM = 32
NOISE = 64
BATCH = 8192
#: Passes over disjoint parts of the training texts; parameters are averaged after each.
ROUNDS = 2
#: Words whose counts go to every task, of LONGEST bytes at most; all others are looked up by a join.
LOOKUP = 200_000
LONGEST = 64
SMOOTH = 0.1
END, REST = 0, 1
#: The end of a text in the count table; no word is empty.
STOP = b""


def tokens(data):
    return data.lower().split()


def count_words(texts):
    """(word, n) over the texts' words and one STOP per text."""

    def run(batches):
        counts = Counter()
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out
        for b in pieces(batches, "text"):
            for t in as_bytes(b, "text"):
                counts.update(tokens(t))
            counts[STOP] += b.num_rows
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts, most=LOOKUP):
    """The most frequent short words, `most` at the utmost, as (word, n) by falling count; all of a count or none.

    A histogram of logarithmic steps finds the smallest count that still fits.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.octet_length("word") > 0))
    total, least = 0, None
    for r in sorted(short.groupBy(step.alias("s")).count().collect(), reverse=True):  # 1,024 rows at most
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in short.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


class LogBilinear:
    """Context vectors, place matrices, word vectors and biases."""

    def __init__(self, unigram, dim=DIM, seed=5):
        rng = np.random.default_rng(seed)
        k = len(unigram)
        self.r = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.c = np.stack([np.eye(dim), np.eye(dim)]).astype(np.float32)
        self.b = np.log(unigram).astype(np.float32)

    def parameters(self):
        return [self.r, self.q, self.c, self.b]

    def flat(self):
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat):
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def train(self, batches, unigram, seed, rate=0.1):
        """One pass of Adagrad over (before, last, next) word numbers; the noise is shared within a batch."""
        rng = np.random.default_rng(seed)
        noise = np.log(NOISE * unigram).astype(np.float32)
        total = np.cumsum(unigram)
        past = [np.ones_like(p) for p in self.parameters()]
        seen = 0

        def step(i, at, g):
            if at is None:
                past[i] += g * g
                self.parameters()[i][...] += rate * g / np.sqrt(past[i])
                return
            order = np.argsort(at, kind="stable")
            s = at[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            g, rows = np.add.reduceat(g[order], first, axis=0), s[first]
            past[i][rows] += g * g
            self.parameters()[i][rows] += rate * g / np.sqrt(past[i][rows])

        for before, last, word in batches:
            n = len(word)
            seen += n
            drawn = np.minimum(np.searchsorted(total, rng.random(NOISE) * total[-1], side="right"), len(unigram) - 1)
            ra, rb = self.r[before], self.r[last]
            p = ra @ self.c[0] + rb @ self.c[1]
            qw, qn = self.q[word], self.q[drawn]
            sd = np.einsum("ij,ij->i", p, qw) + self.b[word] - noise[word]
            sn = p @ qn.T + (self.b[drawn] - noise[drawn])
            gd = 1 / (1 + np.exp(np.clip(sd, -30, 30)))
            gn = -1 / (1 + np.exp(-np.clip(sn, -30, 30)))
            scale = np.float32(1 / np.sqrt(n))
            gd, gn = gd * scale, gn * scale
            dp = gd[:, None] * qw + gn @ qn
            step(0, np.concatenate([before, last]), np.concatenate([dp @ self.c[0].T, dp @ self.c[1].T]))
            step(1, np.concatenate([word, drawn]), np.concatenate([gd[:, None] * p, gn.T @ p]))
            step(2, None, np.stack([ra.T @ dp, rb.T @ dp]))
            step(3, np.concatenate([word, drawn]), np.concatenate([gd, gn.sum(axis=0)]))
        return seen

    def log_normaliser(self, before):
        """ln of the summed exp scores after (before, last) for every last."""
        s = (self.r[before] @ self.c[0] + self.r @ self.c[1]) @ self.q.T + self.b
        top = s.max(axis=1)
        return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def contexts(numbers):
    """(before, last, next) of the word numbers of a text; both places before it hold END."""
    ids = np.asarray(numbers, np.int64)
    return np.concatenate([[END, END], ids[:-2]])[: len(ids)], np.concatenate([[END], ids[:-1]]), ids


def train_model(texts, number, unigram, dim=DIM, rounds=ROUNDS):
    """Train on all `texts` (row, text): tasks train copies on their texts, averaged by words after each round."""
    model = LogBilinear(unigram, dim)
    size = len(model.flat())
    block = 1 << 12
    for i in range(rounds):
        start = model.flat()

        def run(batches, start=start, i=i):
            own = LogBilinear(unigram, dim)
            own.load(start)
            get = number.get
            first = []

            def chunks():
                held, count = [], 0
                for b in pieces(batches, "text"):
                    if not first:
                        first.append(b.column(0)[0].as_py())
                    for t in as_bytes(b, "text"):
                        w = tokens(t)
                        ids = np.fromiter(map(get, w, repeat(REST)), np.int64, len(w))
                        held.append(contexts(np.append(ids, END)))
                        count += len(ids) + 1
                        if count >= BATCH:
                            a = [np.concatenate(x) for x in zip(*held)]
                            held, whole = [], count - count % BATCH
                            for lo in range(0, whole, BATCH):
                                yield [x[lo : lo + BATCH] for x in a]
                            count -= whole
                            held = [[x[whole:] for x in a]] if count else []
                if count:
                    yield [np.concatenate(x) for x in zip(*held)]

            seen = own.train(chunks(), unigram, 100 + i)
            if not seen:
                return
            flat = own.flat().astype(np.float64) * seen
            at = list(range(0, size, block))
            yield pa.RecordBatch.from_arrays([
                pa.array([j // block for j in at], pa.int32()), pa.array([first[0] % 997] * len(at), pa.int32()),
                pa.array([float(seen)] * len(at)), pa.array([flat[j : j + block].tobytes() for j in at], pa.binary())], names=["block", "part", "words", "x"])

        def add(key, table):
            x = sum(np.frombuffer(v, np.float64) for v in table["x"].to_pylist())
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(table["words"].to_pylist())]), pa.array([x.tobytes()], pa.binary())], names=["block", "words", "x"])

        part = texts.where(F.pmod(F.xxhash64(F.lit(41), "row"), F.lit(rounds)) == i)
        sums = part.mapInArrow(run, "block int, part int, words double, x binary")
        sums = sums.groupBy("block", "part").applyInArrow(add, "block int, words double, x binary")
        sums = sums.groupBy("block").applyInArrow(add, "block int, words double, x binary")
        rows = sorted(sums.collect(), key=lambda r: r.block)  # the parameters, once
        if rows:
            model.load((np.concatenate([np.frombuffer(r.x, np.float64) / r.words for r in rows])).astype(np.float32))
    return model


def normalisers(spark, model):
    """ln of the normaliser of every context, a row per task: KNOWN squared numbers in all."""
    k = len(model.b)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([model.log_normaliser(i).astype(np.float32).tobytes()], pa.binary())], names=["id", "z"])

    rows = spark.range(0, k, 1, 12).mapInArrow(run, "id long, z binary").collect()
    z = np.zeros((k, k), np.float32)
    for r in rows:
        z[r.id] = np.frombuffer(r.z, np.float32)
    return z


def score_texts(df, id_col="doc_id", text_col="text", folds=10, known=KNOWN, dim=DIM, lookup=LOOKUP):
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and model come from the rows whose crc32 of the id's text modulo `folds` is not 0.
    Words are parted by ASCII white space, A-Z lower-cased; every text ends with one more token.
    A null text is empty. Rows with a null id are scored, not learned from, not held out.
    Repeated rows get equal scores and count as often as they occur in training. Without
    training rows every token is unseen. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    d = df.select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), held_out(id_col, folds).alias("held_out"),
                  F.coalesce(remainder(id_col, folds) != 0, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learn = d.where("train").select("row", "text")
    counts = materialize(count_words(learn))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    stops = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = frequent(counts, lookup)
    head = top[: known - 2]
    number = {w: i + 2 for i, (w, _) in enumerate(head)}
    inside = stops + sum(n for _, n in head)
    unigram = np.array([stops, total - inside, *(n for _, n in head)], np.float64) + 1
    unigram /= unigram.sum()
    model = train_model(learn, number, unigram, dim)
    z = normalisers(spark, model)
    after = [(model.r @ model.c[j]) @ model.q.T for j in (0, 1)]
    bias = model.b
    base_den = np.log10(total + SMOOTH * (kinds + 1))
    rest_kinds = kinds - len(head) - (stops > 0)
    rest_den = np.log10(total - inside + SMOOTH * (rest_kinds + 1))
    shared = spark.sparkContext.broadcast(([w for w, _ in top], np.array([n for _, n in top], np.float64), after, bias, z))
    tables = {}

    def run(batches):
        if not tables:
            words, n, *matrices = shared.value
            tables["place"] = {w: i for i, w in enumerate(words)}
            tables["log"] = np.log10(np.concatenate([n, [0]]) + SMOOTH)
            tables["rest"] = matrices
        get, log, (after, bias, z) = tables["place"].get, tables["log"], tables["rest"]
        stop = float(np.log10(stops + SMOOTH))
        for b in pieces(batches, "text"):
            out = [[] for _ in range(6)]
            for t in as_bytes(b, "text"):
                w = tokens(t)
                at = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                tail = Counter(w[i] for i in np.flatnonzero(at < 0).tolist())
                found = at[at >= 0]
                m = np.where((at >= 0) & (at < known - 2), at + 2, REST)
                before, last, word = contexts(np.append(m, END))
                ln = after[0][before, word] + after[1][last, word] + bias[word] - z[before, last]
                rest = found[found >= known - 2]
                out[0].append(len(w) + 1)
                out[1].append(len(found) + (stops > 0))
                out[2].append(float(log[found].sum()) + stop - len(found) * base_den - base_den)
                out[3].append(float(ln.sum(dtype=np.float64)) / np.log(10) + float(log[rest].sum()) - len(rest) * rest_den)
                out[4].append(list(tail))
                out[5].append(list(tail.values()))
            cols = [b.column(i) for i in range(3)]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, x) for c, x in zip(out, types))], names=["row", "id", "held_out", "n_tokens", "known", "base", "score", "words", "times"])

    own = d.select("row", "id", "held_out", "text").mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<int>")
    own = materialize(own)
    tail = own.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "w")).select("row", "pos", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    c = counts.withColumnRenamed("word", "word2")
    tail = tail.join(c, tail.word == c.word2, "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"), F.sum("times").alias("times"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n").cast("double"), F.lit(0.0)) + SMOOTH)).alias("log"))
    tail = materialize(tail.select(F.col("row").alias("at"), *((F.col(x) / F.col("copies")).alias(x) for x in ("times", "seen", "log"))))
    none = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    rows = own.drop("words", "times")
    return rows.join(tail, rows.row == tail["at"], "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + none("seen").cast("long")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + none("log") - none("times") * float(base_den)).alias("base_score"),
        (F.col("score") + none("log") - none("times") * float(rest_den)).alias("score"))
