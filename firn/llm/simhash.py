"""SimHash near-duplicates: bit counts per segment bound the distance, a grid join finds candidates."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from firn.llm.common import as_bytes, fresh, pieces, row_key
from firn.llm.components import components
from firn.session import materialize

SHINGLE = 3
SEGMENTS = 32


def fingerprint_of(data, n=SHINGLE):
    """64 majority bits over the XXH64 (seed 42) of all runs of n words of UTF-8 bytes; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(text, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: len(words) - n] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[s:e], 42) for s, e in zip(starts.tolist(), ends[n - 1 :].tolist())], ">u8")
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        count += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(h)).tobytes(), "big")


def fingerprints(df, text_col="text", keep=(), shingle=SHINGLE):
    """The columns `keep` (plain types) and `fp` long, the SimHash of the text.

    A null text counts as one without words: fingerprint 0.
    """
    text, = fresh(df.select(*keep), "text")
    given = df.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = df.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in pieces(batches, text):
            fp = [fingerprint_of(x or b"", shingle) for x in as_bytes(b, text)]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(fp, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return given.mapInArrow(run, schema)


#: Weights that name a grid cell by one number; below 2**55, so that sums stay within 63 bits.
_WEIGHTS = [int(x) | 1 for x in np.random.default_rng(64).integers(1 << 53, 1 << 55, 64)]


def segment_counts(fp, segments=SEGMENTS):
    """The number of set bits in every segment of a 64-bit column, first segment lowest."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1)
    return [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(mask)) for i in range(segments)]


def grid_cells(fp, segments=SEGMENTS):
    """The cells of the unit grid within Manhattan distance 1 of the segment counts.

    Two points at Manhattan distance 2 or less share one of these cells: their middle. A cell is
    named by the weighted sum of its coordinates.
    """
    own = F.lit(0).cast("long")
    for count, w in zip(segment_counts(fp, segments), _WEIGHTS):
        own = own + count * F.lit(w)
    steps = F.array(*[F.lit(s * w) for s in (1, -1) for w in _WEIGHTS[:segments]], F.lit(0).cast("long"))
    return own, steps


def links(fps):
    """Edges (a, b) that connect all distinct fingerprints `fp` at 2 or fewer differing bits.

    The Manhattan distance of the segment counts never exceeds the number of differing bits.
    Fingerprints that share no grid cell with another one are out. The rest is verified exactly:
    two of them are linked when they meet in a 64-bit value that is at most one bit off both, and
    each is tied to the smallest one met there. So a crowded cell costs rows in proportion to its
    members, never their pairs.
    """
    wide = materialize(fps.select("fp").distinct())
    own, steps = grid_cells(F.col("fp"))
    met = wide.select("fp", own.alias("own")).select("fp", "own", F.explode(steps).alias("step"))
    met = materialize(met.select("fp", (F.col("own") + F.col("step")).alias("cell")))
    lively = met.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("cell")
    close = met.join(materialize(lively), "cell", "left_semi").select("fp")
    close = materialize(close.distinct())
    bits = F.array(*[F.lit(int(x)).cast("long") for x in [0, *(np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)]])
    middle = materialize(close.select("fp", F.explode(F.transform(bits, lambda b: b.bitwiseXOR(F.col("fp")))).alias("middle")))
    least = middle.groupBy("middle").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("middle", "b")
    pairs = middle.join(materialize(least), "middle").where("fp <> b")
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2).select(F.col("fp").alias("a"), "b").distinct()


def simhash_groups(df, id_col="doc_id", text_col="text", shingle=SHINGLE):
    """(id, row_key, fp, component_id) per row: the smallest id reachable over links of 2 bits or fewer.

    Null texts and texts without words have fingerprint 0 and are linked like any other. Rows
    with a null id belong to their group; its id is the smallest one that is not null, else
    null. Repeated rows and ids stay. Other columns are ignored. An empty table gives no rows.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = ids.withColumn("row_key", row_key("id", "text"))
    own = materialize(fingerprints(ids, "text", ("id", "row_key"), shingle))
    return grouped(own)


def grouped(own):
    least = materialize(own.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(least))
    both = materialize(least.join(comp, least.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    root = materialize(both.groupBy("component").agg(F.min("least").alias("component_id")))
    of = materialize(both.join(root, "component").select(F.col("fp").alias("at"), "component_id"))
    return own.join(of, own.fp == of["at"]).select("id", "row_key", "fp", "component_id")


def drop_near_duplicates(df, id_col="doc_id", text_col="text", shingle=SHINGLE):
    """One row of every group stays: the smallest id, then the smallest row key, whole and unchanged.

    Fully repeated rows leave one. Columns with any names pass through. Rows without an id
    come after all others in their group.
    """
    groups = materialize(simhash_groups(df, id_col, text_col, shingle).withColumn("order", F.struct(F.col("id").isNull().alias("n"), "id", "row_key")))
    # groups without any id share the null component_id, so a group is named by its fingerprints' component
    first = groups.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("order").alias("o")).select("o.*")
    alone = groups.where("component_id IS NULL")
    first = first.union(alone.groupBy("fp").agg(F.min("order").alias("o")).select("o.*"))
    return kept_rows(df, groups, first, id_col, text_col)


def kept_rows(df, groups, first, id_col, text_col):
    """The rows of `df` that `first` names by id and row_key, each once."""
    first = materialize(first.select(F.col("id").alias("_id"), F.col("row_key").alias("_key")))
    i, k = fresh(df, "_id", "_key")
    keyed = df.withColumn(k, row_key_of(df, id_col, text_col))
    first = first.toDF(i + "2", k + "2")
    kept = keyed.join(first, (keyed[k] == first[k + "2"]) & keyed[id_col].cast("long").eqNullSafe(first[i + "2"]), "left_semi")
    twice = groups.groupBy("id", "row_key").count().where("count > 1")
    if not twice.isEmpty():
        kept = kept.dropDuplicates([k])
    return kept.select(*df.columns)


def row_key_of(df, id_col, text_col):
    return F.xxhash64(F.lit(7), df[id_col].cast("long"), df[text_col].cast("string"))
