"""Mix sources to target weights: hash-seeded Poisson counts, exploded copies, one global shuffle.

Everything is DataFrame functions. The pseudo-random numbers are digits of md5, so SQL engines
agree on them.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window

from firn.llm.common import fresh

SEED = "mix-1"
#: Poisson means above this are drawn as a sum of equal parts.
PART = 16.0
#: Terms of the cumulative distribution of a part; beyond them less than 1e-15 is left.
TERMS = 80
#: Rows that share one place of the global shuffle, about.
BUCKET_ROWS = 2000
_RANGE = 1 << 52


def digits(*parts):
    """52 pseudo-random bits from the md5 of the joined texts."""
    text = F.concat_ws("|", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_rates(df, source_col="source", target=None, weights=None):
    """(source, rate), and how many sources: how often a document of the source is to appear on average.

    `weights` is a table (source, weight); without it every source weighs the square root of
    its rows. Weights are scaled to sum to 1; sources they miss get rate 0. `target` is the
    wanted number of rows, by default as many as there are. Null is a source of its own.
    """
    n = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        w = weights.select(F.col("source").cast("string").alias("s"), F.col("weight").cast("double").alias("weight"))
        n = n.join(w, n.source.eqNullSafe(w.s), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weight, rows, sources = n.agg(F.sum("weight"), F.sum("n"), F.count("*")).first()
    size = float(target if target is not None else rows or 0)
    rate = F.col("weight") / F.lit(weight) * F.lit(size) / F.col("n") if weight else F.lit(0.0)
    return n.select("source", rate.alias("rate")), sources


def poisson_steps(rate):
    """(parts, steps): the mean is split into equal parts, and `steps` are a part's cumulative probabilities."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    mean = rate / parts
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("steps"))
    nxt = lambda a, k: a.p * mean / k
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), start,
        lambda a, k: F.struct(nxt(a, k).alias("p"), (a.c + nxt(a, k)).alias("c"), F.concat(a.steps, F.array(a.c + nxt(a, k))).alias("steps")),
        lambda a: a.steps)
    return parts, steps


def replicate(df, id_col="doc_id", source_col="source", text_col="text", target=None, weights=None, seed=SEED, extra=False):
    """Every document as often as its Poisson count says, in one global random order.

    The count of a document inverts the Poisson distribution of its source's rate at a number
    from the hash of seed, id and text; repeated rows thus appear equally often. Columns keep
    their names. With `extra`, the columns copies, copy (from 1), shuffle_key and position (from
    0, over all rows) follow under names still free; ties of the key go by id, copy and the md5
    of the text. Null ids and texts hash as such, null is a source. An empty table stays empty.
    """
    copies, copy, key, position = fresh(df, "copies", "copy", "shuffle_key", "position")
    base, parts, steps, bucket, src, offset, at = fresh(df, "_base", "_parts", "_steps", "_bucket", "_source", "_offset", "_at")
    rates, sources = source_rates(df, source_col, target, weights)
    p, s = poisson_steps(F.col("rate"))
    rates = rates.select(F.col("source").alias(src), p.alias(parts), s.alias(steps))
    d = df.withColumn(base, F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))))
    rates = F.broadcast(rates) if sources <= 10_000 else rates
    d = d.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(src)))
    one = lambda i: F.size(F.filter(F.col(steps), lambda c: c <= digits(F.col(base), "n", i.cast("string")) / float(_RANGE)))
    d = d.withColumn(copies, F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, i: a + one(i)))
    d = d.drop(parts, steps, src).where(F.col(copies) > 0)
    d = d.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    d = d.withColumn(key, digits(F.col(base), "k", F.col(copy).cast("string")))
    rows = d.select(key).count()
    buckets = max(256, -(-rows // BUCKET_ROWS))
    place = F.floor(F.col(key) * float(buckets) / float(_RANGE)).cast("long")
    d = d.withColumn(bucket, place)
    if not extra:
        return d.repartition(F.col(bucket)).sortWithinPartitions(F.col(bucket), F.col(key)).select(*df.columns)
    count = d.groupBy(bucket).agg(F.count("*").alias(offset))
    before = count.select(F.col(bucket).alias(at), (F.sum(offset).over(Window.orderBy(bucket)) - F.col(offset)).alias(offset))
    order = Window.partitionBy(bucket).orderBy(key, id_col, copy, base)
    d = d.withColumn(position, F.row_number().over(order) - 1)
    d = d.join(F.broadcast(before), F.col(bucket) == F.col(at)) if buckets <= 1_000_000 else d.join(before, F.col(bucket) == F.col(at))
    return d.withColumn(position, F.col(position) + F.col(offset)).select(*df.columns, copies, copy, key, position)


#: The same rows in DuckDB.
MIX_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight / sum(weight) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM n),
p AS (SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM r),
t AS (SELECT source, parts, k, exp(-mean) * coalesce(pow(mean, k) / gamma(k + 1), 0) AS q
      FROM p, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
s AS (SELECT source, parts, list(c) AS steps FROM
      (SELECT source, parts, sum(q) OVER (PARTITION BY source ORDER BY k) AS c FROM t) GROUP BY source, parts),
d AS (SELECT doc_id, d.source, md5(text) AS text_md5, parts, steps,
      concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(text), 'null')) AS base
      FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
u AS (SELECT doc_id, source, text_md5, base, steps, unnest(range(1, parts + 1)) AS i FROM d),
v AS (SELECT *, ('0x' || substr(md5(base || '|n|' || i), 1, 13))::BIGINT / {float(_RANGE)} AS x FROM u),
c AS (SELECT doc_id, source, text_md5, base, sum(len(list_filter(steps, lambda y: y <= x)))::INT AS copies
      FROM v GROUP BY ALL),
e AS (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM c),
k AS (SELECT *, ('0x' || substr(md5(base || '|k|' || copy), 1, 13))::BIGINT AS shuffle_key FROM e)
SELECT doc_id, source, copies, copy, shuffle_key, text_md5,
       row_number() OVER (ORDER BY shuffle_key, doc_id, copy, base) - 1 AS position FROM k
"""


def mixed_documents(df):
    """The digest of the replicated documents; the text's md5 is taken after the shuffle."""
    out = replicate(df.select("doc_id", "text", "source"), extra=True)
    return out.select("doc_id", "source", "copies", "copy", "shuffle_key", F.md5(F.col("text").cast("binary")).alias("text_md5"), "position")
