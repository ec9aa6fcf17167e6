"""Language ID: TF-IDF vectors of letter trigrams against several centroids per language."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firn.llm.common import fresh, held_out, pieces, remainder
from firn.session import materialize

DIMS = 4096
CENTROIDS = 4
#: Labelled rows per language that the centroids are fitted on, about; the idf covers all rows.
SAMPLE = 600
#: A text of EVIDENCE different trigrams or more that has a smaller cosine than FLOOR to every
#: centroid belongs to no learned language. With fewer trigrams a text can only cover a smaller
#: part of a centroid, so the floor falls with their number, to zero at HINT, a word of two or three letters.
FLOOR = 0.2
EVIDENCE = 64
HINT = 4
UNKNOWN = "und"

#: Every ASCII byte that is no letter counts as a space.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def has_letter(text):
    return text is not None and any(map(str.isalpha, text))


def trigram_counts(text, dims=DIMS):
    """How often each of the hashed byte trigrams occurs in the lower-cased text, without runs of spaces."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(dims, np.float32)
    code = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:])[(a[1:-1] != 32) | ((a[:-2] != 32) & (a[2:] != 32))]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
    return np.bincount(slot, minlength=dims).astype(np.float32)


def vectors(texts, idf):
    """Unit TF-IDF rows; a text without trigrams is the zero row."""
    x = np.zeros((len(texts), len(idf)), np.float32)
    for i, t in enumerate(texts):
        if t:
            x[i] = trigram_counts(t, len(idf))
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def spherical_kmeans(x, k, seed=17, rounds=8):
    """Unit centroids of unit rows by cosine; empty clusters go."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        best = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = (sums / np.where(norm > 0, norm, 1)[:, None])[norm > 0]
    return c


class LanguageModel:
    """Learned languages, their centroids and the idf of the trigrams: a few hundred kB per language."""

    def __init__(self, langs, centroids, idf, floor=FLOOR):
        self.langs, self.centroids, self.idf, self.floor = langs, centroids, idf, floor

    def predict(self, texts):
        """(language, cosine with its nearest centroid, fits a learned language) per text."""
        out = []
        for lo in range(0, len(texts), 256):
            block = texts[lo : lo + 256]
            x = vectors(block, self.idf)
            cos = x @ self.centroids.T
            floor = self.floor * np.clip(((x > 0).sum(axis=1) - HINT) / (EVIDENCE - HINT), 0, 1)
            best = cos.argmax(axis=1)
            top = np.clip(cos[np.arange(len(block)), best], 0, 1)
            near = top >= floor
            for t, b, s, ok in zip(block, best.tolist(), top.tolist(), near.tolist()):
                out.append((self.langs[b], s, ok) if has_letter(t) else (UNKNOWN, 0.0, False))
        return out


def document_frequencies(df, text_col, dims=DIMS):
    """(slot, n): in how many texts each trigram occurs; slot -1 counts the texts."""

    def run(batches):
        total = np.zeros(dims + 1, np.int64)
        for b in pieces(batches, "text"):
            for t in b.column(0).to_pylist():
                if t is not None:
                    total[:-1] += trigram_counts(t, dims) > 0
                    total[-1] += 1
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(slot == dims, -1, slot)), pa.array(total[slot])], names=["slot", "n"])

    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot long, n long")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"))


def fit_language(df, text_col="text", lang_col="lang", id_col="doc_id", dims=DIMS, k=CENTROIDS, sample=SAMPLE, floor=FLOOR):
    """Learn from the rows whose text and language are given; None when there are none.

    The idf counts all rows. About `sample` rows of every language, chosen by a hash of id and
    text, are clustered into `k` centroids. Ties and repeated rows count as often as they occur.
    """
    known = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id")).where("text IS NOT NULL AND lang IS NOT NULL")
    langs = materialize(known.groupBy("lang").count())
    size = langs.count()
    if not size:
        return None
    counts = {r.slot: r.n for r in document_frequencies(known, "text", dims).collect()}  # dims + 1 rows at most
    idf = np.log((1 + counts.get(-1, 0)) / (1 + np.array([counts.get(i, 0) for i in range(dims)], float))).astype(np.float32) + np.float32(1)
    rate = langs.select(F.col("lang").alias("l"), (F.lit(float(sample)) / F.col("count")).alias("rate"))
    chosen = known.select("text", "lang", (F.pmod(F.xxhash64(F.lit(31), "id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("u"))
    rate = F.broadcast(rate) if size <= 10_000 else rate
    chosen = chosen.join(rate, chosen.lang == rate.l).where("u < rate").select("lang", "text")

    def embed(batches):
        for b in pieces(batches, "text"):
            x = vectors(b.column(1).to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    def cluster(key, pdf):
        x = np.stack([np.frombuffer(r, np.float32) for r in sorted(pdf["x"])])
        c = spherical_kmeans(x, k)
        return pd.DataFrame({"lang": [key[0]] * len(c), "c": [r.tobytes() for r in c]})

    out = chosen.mapInArrow(embed, "lang string, x binary").groupBy("lang").applyInPandas(cluster, "lang string, c binary")
    rows = sorted(out.collect(), key=lambda r: (r.lang, r.c))  # k rows per language
    if not rows:
        return None
    return LanguageModel([r.lang for r in rows], np.stack([np.frombuffer(r.c, np.float32) for r in rows]), idf, floor)


def predict_language(df, model, text_col="text", keep=None):
    """The columns `keep` (all by default) and `lang_pred`, `score`, `accepted` under names still free.

    A null text or one without any letter is `und`, score 0, not accepted. A text whose nearest
    centroid is farther than the model's floor, which is lower for short texts, keeps the nearest
    language but is not accepted.
    Without a model every row is `und`, not accepted. Empty tables give no rows.
    """
    keep = df.columns if keep is None else list(keep)
    given = df.select(*keep)
    pred, score, accepted, text = fresh(given, "lang_pred", "score", "accepted", "text_")
    schema = T.StructType([*given.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(accepted, T.BooleanType())])
    given = df.select(*keep, df[text_col].cast("string").alias(text))

    def run(batches):
        for b in pieces(batches, text):
            texts = b.column(b.num_columns - 1).to_pylist()
            found = model.predict(texts) if model else [(UNKNOWN, 0.0, False)] * len(texts)
            lang, s, ok = zip(*found)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(ok, pa.bool_())], names=[*keep, pred, score, accepted])

    return given.mapInArrow(run, schema)


def training_rows(df, id_col="doc_id"):
    return df.where(remainder(id_col, 5) != 0)


def identify(df):
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    model = fit_language(training_rows(df))
    rows = df.withColumn("held", held_out("doc_id", 5)).select("doc_id", F.col("held").alias("held_out"), "text")
    return predict_language(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def keep_identified(df, **options):
    """The rows whose text fits a learned language, unchanged; repeated rows are judged alike.

    Null texts, texts without a letter and texts far from all learned languages go. Where no row
    has both a text and a language nothing can be learned, and all rows stay. Empty stays empty.
    """
    model = fit_language(training_rows(df), **options)
    if model is None:
        return df
    tagged = predict_language(df, model)
    return tagged.where(F.col(tagged.columns[-1])).select(*df.columns)
