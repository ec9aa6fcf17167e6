"""One query per operator, over its whole table, and its SQL where SQL can state it."""

from firn.llm import contamination, conversations, exact, graph, language, lm, mixing, pii, quality, sharding, simhash, spelling, substrings
from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark, sf_dir):
    return graph.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return contamination.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).withColumnRenamed("id", "doc_id")


def op7_substrings(spark, sf_dir):
    out, _ = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op8_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark, sf_dir):
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_spelling_groups(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark, sf_dir):
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_simhash, op3_language, op4_sharding, op5_decontamination, op6_quality, op7_substrings, op8_personal_data, op9_mixing, op10_lm_scores, op11_spelling_groups, op12_exact_dedup, op13_prefix_trie)}
SQL = {"op9_mixing": mixing.MIX_SQL, "op11_spelling_groups": spelling.SPELLING_SQL, "op12_exact_dedup": exact.EXACT_SQL, "op13_prefix_trie": conversations.TRIE_SQL}
