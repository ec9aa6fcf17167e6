"""Document quality from a linear-chain conditional random field over lines."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from firn.llm.common import as_bytes, held_out, pieces, remainder, word_hashes

#: Labelled documents the field is fitted on, about, and the longest chain of lines one gives.
SAMPLE = 6_000
CHAIN = 256
CUTOFF = 0.3

_CLASS = np.zeros((256, 6), np.float32)
for _c in range(256):
    _k = chr(_c) if _c < 128 else "é"
    _CLASS[_c] = [_k.isalpha() and not _k.isupper(), _k.isupper(), _k.isdigit(), _k == "|", _k in "!?", _k in "#$%&*@<>{}[]=~^_\\"]
OWN = 14


def line_features(texts):
    """(rows of features, lines per text, bytes per line) of the lines of UTF-8 texts.

    A line's own features: shares of character classes, its length, shares of words that repeat
    the word before or any word of the line, word length, sentence end, whether the same line
    stands before it or anywhere above. Then the same of the line before and of the line after.
    A text without lines counts as one empty line.
    """
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = b"\n".join(texts)
    a = np.frombuffer(data, np.uint8)
    n = int(counts.sum())
    cut = np.flatnonzero(a == 10)
    start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(a)]])
    size = (end - start).astype(np.float64)
    f = np.zeros((n, OWN), np.float32)
    some = np.maximum(size, 1)
    if len(a):
        for k in range(6):
            total = np.concatenate([[0], np.cumsum(_CLASS[a, k], dtype=np.float64)])
            f[:, k] = (total[end] - total[start]) / some
    f[:, 6] = np.log1p(size) / 8
    ws, we, h = word_hashes(data)
    line = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(line, minlength=n)
    if len(h):
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (line[1:] == line[:-1])])
        f[:, 7] = np.bincount(line, again, n) / np.maximum(words, 1)
        key = np.sort((line.astype(np.uint64) << np.uint64(40)) ^ (h >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        f[:, 8] = 1 - np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(words, 1)
        f[:, 9] = np.bincount(line, we - ws, n) / np.maximum(words, 1) / 16
    last = a[np.maximum(end - 1, 0)] if len(a) else np.zeros(n, np.uint8)
    f[:, 10] = (size > 0) & np.isin(last, np.frombuffer(b".!?:", np.uint8))
    f[:, 11] = size == 0
    text = np.repeat(np.arange(len(texts)), counts)
    names = [hash(x) for x in data.split(b"\n")]
    same = np.zeros(n, np.float32)
    seen = set()
    at = -1
    for i, (t, x) in enumerate(zip(text.tolist(), names)):
        if t != at:
            seen, at = set(), t
        same[i] = x in seen
        seen.add(x)
    f[:, 12] = same * (size > 0)
    f[1:, 13] = (np.array(names[1:]) == np.array(names[:-1])) & (text[1:] == text[:-1]) & (size[1:] > 0)
    full = np.zeros((n, 3 * OWN + 3), np.float32)
    full[:, :OWN] = f
    edge = text[1:] == text[:-1]
    full[1:, OWN : 2 * OWN] = f[:-1] * edge[:, None]
    full[:-1, 2 * OWN : 3 * OWN] = f[1:] * edge[:, None]
    full[1:, 3 * OWN] = edge
    full[:-1, 3 * OWN + 1] = edge
    full[:, 3 * OWN + 2] = 1
    return full, counts, size


def forward_backward(emission, counts, step, first):
    """Log-domain forward-backward of two-state chains side by side.

    `emission` (lines, 2), `counts` lines per chain, `step` (2, 2) from-to scores, `first` (2,).
    Returns the marginals per line, the log normaliser per chain and expected transitions.
    """
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    begin, length = begin[order], counts[order]
    lse = lambda x: np.logaddexp(x[..., 0], x[..., 1])
    alpha, beta = np.zeros_like(emission), np.zeros_like(emission)
    alpha[begin] = emission[begin] + first
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    for t in range(1, len(live)):
        at = begin[: live[t]] + t
        alpha[at] = emission[at] + lse((alpha[at - 1][:, :, None] + step).transpose(0, 2, 1))
    z = np.empty(len(counts))
    z[order] = lse(alpha[begin + length - 1])
    moves = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        at = begin[: live[t]] + t
        ahead = emission[at] + beta[at]
        beta[at - 1] = lse(step + ahead[:, None, :])
    norm = np.repeat(z, counts)
    marginal = np.exp(alpha + beta - norm[:, None])
    inner = np.ones(len(emission), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    if len(at):
        pair = alpha[at - 1][:, :, None] + step + (emission[at] + beta[at])[:, None, :] - norm[at][:, None, None]
        moves = (np.exp(pair), at)
    else:
        moves = (np.zeros((0, 2, 2)), at)
    return marginal, z, moves


class LineField:
    """Weights of the line features for `good` over `bad`, transition scores and start scores."""

    def __init__(self, width):
        self.w, self.step, self.first = np.zeros(width), np.zeros((2, 2)), np.zeros(2)
        self.scale = (1.0, 0.0)

    def emission(self, x):
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ self.w
        return e

    def fit(self, x, counts, label, rounds=250, rate=0.1, ridge=1e-4):
        """Adam on the log-likelihood of chains whose lines all carry the document's label."""
        x = x.astype(np.float64)
        weight = 1 / np.sqrt(counts)
        y = np.repeat(label, counts)
        lw = np.repeat(weight, counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        theta = np.zeros(len(self.w) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, rounds + 1):
            self.w, self.step, self.first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            p, _, (pair, at) = forward_backward(self.emission(x), counts, self.step, self.first)
            gw = x.T @ (lw * (y - p[:, 1]))
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[at], y[at]), lw[at])
            gs = seen - (pair * lw[at][:, None, None]).sum(axis=0)
            gf = np.bincount(label, weight, 2) - (p[begin] * weight[:, None]).sum(axis=0)
            g = np.concatenate([gw, gs.ravel(), gf]) / weight.sum() - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.w, self.step, self.first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        size = np.expm1(8 * x[:, 6])
        self.scale = logistic(self.means(x, counts, size), label)
        return self

    def means(self, x, counts, size):
        """Log-odds of the mean chance of a good line, every line weighted by its length."""
        p, _, _ = forward_backward(self.emission(x), counts, self.step, self.first)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = size + 1
        mean = np.add.reduceat(p[:, 1] * weight, begin) / np.add.reduceat(weight, begin)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts):
        """Per text the chance of label 1, from the weighted mean by the fitted logistic curve."""
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.means(*line_features(texts)) + b)))


def logistic(x, label, rounds=50):
    """Slope and offset of P(label = 1) = 1 / (1 + exp(-(a x + b))) by Newton's method with a small ridge."""
    theta = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ theta))
        g = z.T @ (label - p) - 1e-2 * (theta - [1, 0])
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        theta = theta + np.linalg.solve(h, g)
    return max(theta[0], 1e-3), theta[1]


def labelled_chains(docs, labels, sample=SAMPLE, id_col="doc_id", text_col="text", label_col="quality"):
    """About `sample` labelled documents, chosen by a hash of the id, as features of CHAIN lines at most."""
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(remainder("id", 5) != 0)
    n = lab.count()
    lab = lab.where(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(n, 1)))))
    lab = F.broadcast(lab) if lab.count() <= 4 * sample else lab
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.join(lab, d.doc == lab.id).select("doc", "label", "text")

    def run(batches):
        for b in pieces(batches, "text"):
            out = []
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b, "text")):
                x, _, _ = line_features([t])
                lo = (i * 7919) % max(1, len(x) - CHAIN + 1)
                out.append(x[lo : lo + CHAIN].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc", "label", "x"])

    return d.mapInArrow(run, "doc long, label int, x binary")


def fit_quality(docs, labels, **options):
    """A fitted field, or None without labelled rows to learn from. Labels of held-out rows are not read."""
    width = 3 * OWN + 3
    rows = sorted(labelled_chains(docs, labels, **options).collect(), key=lambda r: (r.doc, r.label, r.x))
    if not rows:
        return None
    x = [np.frombuffer(r.x, np.float32).reshape(-1, width) for r in rows]
    return LineField(width).fit(np.concatenate(x), np.array([len(c) for c in x]), np.array([r.label for r in rows]))


def score_quality(df, model, id_col="doc_id", text_col="text"):
    """Per row: id, held_out, score, predicted. Null and empty texts are one empty line.

    Without a model every score is 0.5. Null ids stay and are not held out; repeated rows get
    equal scores; other columns are ignored; an empty table gives no rows.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, 5).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in pieces(batches, "text"):
            s = model.scores(as_bytes(b, "text")) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= CUTOFF).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return d.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
