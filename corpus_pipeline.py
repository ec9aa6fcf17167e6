"""From raw documents to training shards: language ID, near-dedup, decontamination, mixing, sharding."""

from firn.llm import contamination, language, mixing, sharding, simhash
from firn.session import materialize


def identify(spark, docs, sf_dir):
    """Documents whose text fits a learned language."""
    return language.keep_identified(docs)


def dedup(spark, docs, sf_dir):
    """One document of every group of near copies stays, as op2 links them: 3-word shingles, at most 2 bits."""
    return simhash.drop_near_duplicates(docs, shingle=3)


def decontaminate(spark, docs, sf_dir):
    """Documents that copy no benchmark item."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Documents repeated to the sources' target weights, in random order."""
    return mixing.replicate(docs)


def shard(spark, docs, sf_dir):
    """Documents with their shard and their slot in it."""
    return sharding.shuffle_shards(docs)


STAGES = [("language_id", identify), ("simhash_near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL can express neither the fingerprints nor the alignments; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
