"""Two-pass external shuffle into shards: hash scatter into buckets, Fisher-Yates inside each."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firn.llm.common import fresh
from firn.session import materialize

BUCKET_BYTES = 64 << 20
BUCKETS = 256
#: Bytes that all copies of one (id, text) may take in a bucket, ROW for each and its text; beyond, they are scattered singly.
HOT = BUCKET_BYTES // 8
ROW = 100


def fisher_yates(n, rng):
    """A uniform permutation of 0..n-1."""
    order = list(range(n))
    draw = rng.random(n)
    for i in range(n - 1, 0, -1):
        j = int(draw[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def scattered(df, id_col, text_col, seed, hot, names):
    """`df` with two row hashes and a copy number that tells apart the copies of very frequent rows."""
    a, b, copy = names
    key = lambda s: F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col), F.col(text_col))
    d = df.withColumn(a, key(1)).withColumn(b, key(2))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    often = d.groupBy(a).agg(F.count("*").alias("n"), F.sum(size + 8).alias("bytes"))
    often = materialize(often)
    rows, size = often.agg(F.sum("n"), F.sum("bytes")).first()
    crowd = often.where((F.col("n") > 1) & (F.col("bytes") + F.col("n") * (ROW - 8) > hot)).select(F.col(a).alias("h"))
    many = crowd.count()  # at most bytes / hot
    if not many:
        return d.withColumn(copy, F.lit(0).cast("long")), rows or 0, size or 0
    crowd = F.broadcast(crowd) if many <= 10_000 else crowd
    rest = d.join(crowd, d[a] == crowd.h, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    same = d.join(crowd, d[a] == crowd.h, "left_semi").groupBy(*d.columns).agg(F.count("*").alias(copy))
    return rest.unionByName(same.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))), rows, size


def shuffle_shards(df, shards=24, id_col="doc_id", text_col="text", seed=11, bucket_bytes=BUCKET_BYTES, buckets=BUCKETS, hot=HOT):
    """All rows with `shard` (from 0) and `slot` (gapless from 0 within the shard), under names still free.

    Pass one deals the rows to buckets of about `bucket_bytes` by a seeded hash of id and text.
    Pass two puts each bucket into a fixed order and shuffles it by Fisher-Yates. The buckets one
    after the other are a permutation of the table, cut into shards whose row counts differ by one
    at most. The result is a function of the rows and the seed. Rows equal in id and text change
    places freely; where together they pass `hot` bytes, those equal in all columns count as copies
    of one row and are dealt singly. Nulls hash as such. An empty table stays empty.
    """
    a, b, copy, bucket, shard, slot = fresh(df, "_a", "_b", "_copy", "_bucket", "shard", "slot")
    d, rows, size = scattered(df, id_col, text_col, seed, hot, (a, b, copy))
    n = max(buckets, -(-size // bucket_bytes))
    d = d.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), a, copy), F.lit(n)).cast("int"))
    start = np.zeros(n + 1, np.int64)  # 8 bytes per bucket of text
    for r in d.groupBy(bucket).count().collect():
        start[r[0] + 1] = r[1]
    start = np.cumsum(start)
    bounds = (np.arange(1, shards + 1, dtype=object) * rows // shards).astype(np.int64)
    schema = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])
    names = df.columns

    def deal(key, table):
        k = key[0].as_py()
        order = np.lexsort([table.column(c).to_numpy() for c in (copy, b, a)])
        order = order[fisher_yates(table.num_rows, np.random.default_rng([seed, k]))]
        place = start[k] + np.arange(table.num_rows)
        to = np.searchsorted(bounds, place, side="right")
        first = np.concatenate([[0], bounds])[to]
        moved = table.select(names).take(pa.array(order))
        return pa.table([*moved.columns, pa.array(to, pa.int32()), pa.array(place - first, pa.int64())], names=[*names, shard, slot])

    return d.groupBy(bucket).applyInArrow(deal, schema)


def write_shards(sharded, path, shard_col="shard"):
    """One folder of parquet files per shard, the rows of every file in slot order of its bucket."""
    sharded.write.partitionBy(shard_col).parquet(path)


def sharded_documents(df, shards=24):
    """The digest per document, taken from the written shards."""
    out = materialize(shuffle_shards(df.select("doc_id", "text"), shards))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
