"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman scores them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window

from firn.llm.common import as_bytes, gram_hashes, pieces, row_key, fresh, word_hashes
from firn.session import materialize

SEED_WORDS = 3
#: Every stretch of so many n-grams of an item gives its rarest one as a seed.
STRETCH = 4
#: Share of the best possible alignment score from which on a passage is a copy of the item.
THRESHOLD = 0.5
#: Slots of the filter that tells tasks which n-grams may be seeds: 512 kB whatever the benchmark's size.
SLOTS = 1 << 22
MATCH, MISS, GAP = 2, -1, -1

#: ASCII punctuation separates words, like white space.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def plain(text):
    """Lower-cased UTF-8 bytes without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN)


def smith_waterman(a, b):
    """Best local alignment score of two word-number arrays with linear gaps, and where it ends in b.

    One row of the score matrix at a time; gaps along the row come from a running maximum.
    """
    best, end = 0, 0
    step = np.arange(len(b) + 1) * -GAP
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        up = np.zeros(len(b) + 1, np.int64)
        up[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISS), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(up, 0) + step) - step, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def alignment(item, passage):
    """Alignment score of two word lists over the best that the item allows, 0 to 1."""
    number = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (item, passage))
    if not len(a) or not len(b):
        return 0.0
    return smith_waterman(a, b)[0] / (MATCH * len(a))


def _slots(grams):
    return (grams >> np.uint64(64 - 22)).astype(np.int64)


def _grams(data, n):
    """Hashes of the runs of n words; a shorter text is one run."""
    words = word_hashes(data)[2]
    return gram_hashes(words, min(n, len(words))) if len(words) else words


def _filter(hashes):
    """A bit field over the slots of the hashes; at most SLOTS slot numbers reach the driver."""
    slot = F.shiftrightunsigned(F.col("gram"), 64 - 22).cast("int")
    found = [r[0] for r in hashes.select(slot.alias("s")).distinct().collect()]
    bits = np.zeros(SLOTS, bool)
    bits[np.array(found, np.int64)] = True
    return np.packbits(bits)


def _item_grams(items, n):
    """(item, pos, gram, words) for every n-gram of every item."""

    def run(batches):
        for b in pieces(batches, "text"):
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            g = [_grams(plain(t), n) for t in rows]
            count = [len(x) for x in g]
            flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
            pos = np.concatenate([np.arange(c) for c in count]) if count else np.zeros(0, np.int64)
            words = np.repeat([len(plain(t).split()) for t in rows], count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), count)), pa.array(pos, pa.int64()), pa.array(flat.view(np.int64)), pa.array(words, pa.int64())], names=["item", "pos", "gram", "words"])

    return items.mapInArrow(run, "item long, pos long, gram long, words long")


def _frequencies(docs, bits, n):
    """(gram, df) over all documents for the n-grams that pass the filter."""

    def run(batches):
        has = np.unpackbits(bits).astype(bool)
        counts = {}
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.array(list(counts), np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["gram", "df"])
            counts.clear()
            return out
        for b in pieces(batches, "text"):
            for t in b.column(0).to_pylist():
                g = _grams(plain(t), n)
                for x in np.unique(g[has[_slots(g)]]).tolist():
                    counts[x] = counts.get(x, 0) + 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def _passages(docs, bits, n, reach):
    """(key, id, part, gram, at, passage): documents' seed hits, those near each other in one passage.

    A passage reaches `reach` words beyond its first and last hit.
    """

    def run(batches):
        has = np.unpackbits(bits).astype(bool)
        for b in pieces(batches, "text"):
            rows = []
            for key, i, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                data = plain(t)
                g = _grams(data, n)
                hit = np.flatnonzero(has[_slots(g)])
                if not len(hit):
                    continue
                words = data.split()
                for part, h in enumerate(np.split(hit, np.flatnonzero(np.diff(hit) > reach) + 1)):
                    lo = max(0, int(h[0]) - reach)
                    passage = b" ".join(words[lo : int(h[-1]) + n + reach]).decode("utf-8", "replace")
                    rows.append((key, i, part, g[h].view(np.int64).tolist(), passage))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()))], names=["key", "id", "part", "grams", "passage"])

    return docs.mapInArrow(run, "key long, id long, part int, grams array<long>, passage string")


def contaminated(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", n=SEED_WORDS, threshold=THRESHOLD):
    """(row_key, id, item_id, score): documents with a passage that copies a benchmark item, with edits or none.

    Words are lower-cased and parted by white space and ASCII punctuation. Every STRETCH n-grams
    of an item give their rarest one (by documents that hold it; ties by hash) as a seed, however
    frequent it is, so items that many documents copy are found as well. A passage around the
    seed hits is aligned with the item; the score is the share of the item's best one. Items of
    fewer than n words are one seed. Null or empty texts and items match nothing; null ids are
    kept; repeated rows are found each; empty tables give no rows.
    """
    it = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    d = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    grams = materialize(_item_grams(it, n))
    reach = grams.agg(F.max("words")).first()[0]
    seeds = None
    if reach:
        df = _frequencies(d, _filter(grams), n)
        rare = grams.join(df, "gram", "left").select("item", "pos", "gram", F.coalesce("df", F.lit(0)).alias("df"))
        order = Window.partitionBy("item", F.floor(F.col("pos") / STRETCH)).orderBy("df", "gram", "pos")
        seeds = materialize(rare.withColumn("r", F.row_number().over(order)).where("r = 1").select("gram", "item").distinct())
    if seeds is None:
        return d.sparkSession.createDataFrame([], "row_key long, id long, item_id long, score double")
    found = _passages(d, _filter(seeds), n, int(reach)).select("key", "id", "part", "passage", F.explode(F.array_distinct("grams")).alias("gram"))
    found = materialize(found)
    pairs = found.join(seeds, "gram").groupBy("key", "id", "part", "item").agg(F.first("passage").alias("passage"))
    pairs = materialize(pairs)
    wanted = it.select(F.col("item").alias("item2"), F.col("text").alias("wanted"))
    pairs = pairs.join(wanted, pairs.item == wanted.item2).select("key", "id", "item", "passage", "wanted")

    def run(batches):
        known = {}
        for b in pieces(batches, "passage"):
            score = []
            for p, w in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if len(known) > 10_000:
                    known.clear()
                if (p, w) not in known:
                    known[p, w] = alignment(plain(w).split(), plain(p).split())
                score.append(known[p, w])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score, pa.float64())], names=["row_key", "id", "item_id", "score"])

    scored = pairs.mapInArrow(run, "row_key long, id long, item_id long, score double").where(F.col("score") >= threshold)
    return scored.groupBy("row_key", "id", "item_id").agg(F.max("score").alias("score"))


def contaminated_documents(docs, items):
    """One row per document and item it copies: doc_id, item_id, score."""
    return contaminated(docs, items).groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs, items, id_col="doc_id", text_col="text", **options):
    """The rows without a copied benchmark passage, unchanged."""
    bad = contaminated(docs, items, id_col, text_col, **options).select("row_key", F.col("id").alias("_id")).distinct()
    key, k2, i2 = fresh(docs, "_key", "_key2", "_id2")
    bad = materialize(bad).toDF(k2, i2)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    same = (keyed[key] == bad[k2]) & keyed[id_col].cast("long").eqNullSafe(bad[i2])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
