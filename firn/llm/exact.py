"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the whole text.

DataFrame functions only. Two passes over the texts; what they leave are a few numbers per row.
"""

from pyspark.sql import functions as F

from firn.llm.common import attach, fresh
from firn.session import materialize

#: Characters of the prefix.
PREFIX = 256
#: Places of the survivors' filter, 64 bits each: 2 MB to broadcast, whatever the table's size.
PLACES = 1 << 17


def normal(text_col):
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(*keys):
    return F.pmod(F.xxhash64(F.lit(12), *keys), F.lit(PLACES * 64))


def bits(keys, *names):
    """At most PLACES rows (place, bits): a bit is set for every row of `keys`."""
    slot = keys.select(_slot(*names).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    return materialize(slot.groupBy(F.expr("slot div 64").alias("place")).agg(F.bit_or(bit).alias("bits")))


def probe(df, filter_bits, flag, *names):
    """`df` with a flag: false only where the filter holds no row with the same key."""
    slot, place, held = fresh(df, "_slot", "_place", "_bits")
    d = df.withColumn(slot, _slot(*names))
    f = F.broadcast(filter_bits.select(F.col("place").alias(place), F.col("bits").alias(held)))
    d = d.join(f, F.expr(f"{slot} div 64") == F.col(place), "left")
    return d.withColumn(flag, F.expr(f"coalesce(shiftright({held}, cast({slot} % 64 as int)) & 1L, 0L) = 1L")).drop(slot, place, held)


def survivors(short):
    """The filter of the (length, prefix) keys that more than one row bears.

    Rows go on to the next level only while others are like them: first the lengths that occur
    once are out, then the prefixes.
    """
    lengths = bits(short.groupBy("length").count().where("count > 1"), "length")
    left = probe(short, lengths, "alive", "length").where("alive")
    return bits(left.groupBy("length", "prefix").count().where("count > 1"), "length", "prefix")


def exact_groups(df, id_col="doc_id", text_col="text", digest=False):
    """(id, keep_id, group_size, kept, text_sha256), one row per row of `df`.

    Texts are equal when they are identical after every run of white space became one space; a
    null text counts as empty. Of equal texts the row with the smallest id stays; rows without
    an id come after all others, and of rows with the same id just one stays. `keep_id` is null
    where no row of the group has an id. Only rows that share length and prefix with another
    have their whole text hashed (`text_sha256` is null elsewhere), unless `digest` asks for all.
    Other columns are ignored. An empty table gives no rows.
    """
    base = df.select(F.col(id_col).alias("id"), normal(text_col).alias("norm"))
    keys = base.withColumns({"length": F.octet_length("norm").cast("long"), "prefix": F.xxhash64(F.lit(3), F.substring("norm", 1, PREFIX))})
    short = materialize(keys.select("length", "prefix"))
    seen = probe(keys, survivors(short), "alive", "length", "prefix")
    full = F.sha2(F.col("norm").cast("binary"), 256)
    # The row number is written with the row, so it stays the same whenever it is read again.
    hashed = materialize(seen.select("id", F.monotonically_increasing_id().alias("row"), "alive", (full if digest else F.when(F.col("alive"), full)).alias("text_sha256")))
    alike = hashed.where("alive")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = alike.groupBy("text_sha256").agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1")
    groups = materialize(groups.select("text_sha256", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")))
    found = attach(alike, groups, "text_sha256", "group_size")
    one = F.col("group_size").isNull()
    found = found.select(
        "id", F.when(one, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256")
    alone = hashed.where("NOT alive").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return found.unionByName(alone)


def drop_copies(df, id_col="doc_id", text_col="text"):
    """The rows of `df` that stay, whole and unchanged, whatever their other columns are called.

    As `exact_groups` decides; of rows with the same id and equal texts any one stays.
    """
    groups = materialize(exact_groups(df, id_col, text_col))
    stay = groups.where("kept").select("id", "text_sha256")
    gone = materialize(groups.where("NOT kept").select("id", "text_sha256").distinct())
    i, h = fresh(df, "_id", "_sha256")
    keyed = df.withColumn(h, F.sha2(normal(text_col).cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(h + "2"))
    both = materialize(gone.join(stay, gone.id.eqNullSafe(stay.id) & (gone.text_sha256 == stay.text_sha256), "left_semi"))
    names = lambda t: t.select(F.col("id").alias(i), F.col("text_sha256").alias(h + "2"))
    out = keyed.join(names(gone), same, "left_anti")
    if not both.isEmpty():  # rows repeated with their id: one of each comes back
        out = out.unionByName(keyed.join(names(both), same, "left_semi").dropDuplicates([id_col, h]))
    return out.select(*df.columns)


#: The same rows in DuckDB.
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
