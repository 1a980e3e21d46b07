"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, html, licenses, negatives, packing, secrets, topk
from logloom.llm.embeddings import near_vectors
from logloom.llm.minhash import near_duplicates
from logloom.llm.quality import repetition_coverage
from logloom.llm.spelling import spelling_variants
from logloom.llm.substrings import remove_repeated_windows
from logloom.llm.suffixes import remove_earlier_strings
from logloom.session import scratch_dir


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> tuple[str, str]:
    """Where the public vocabulary lies on every host, and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_coverage(_table(spark, folder, "documents"))


def op2_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles and a similarity of 0.85, as its contract says."""
    return near_duplicates(_table(spark, folder, "documents"), n=3, percent=85)


def op3_level_doubling(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_windows(_table(spark, folder, "documents"), digests=True)


def op4_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A first scan with an empty ledger; the digests come from the findings."""
    found = secrets.scan(_table(spark, folder, "documents"), scratch_dir(spark, "ledger"))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def of(kinds):
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    def spelled(spans):
        return F.array_join(
            F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))),
            ",",
        )

    return found.select(
        "doc_id",
        *[F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spelled(of(base)), 256).alias("base_sha256"),
        spelled(F.col("findings")).alias("spans"),
    )


def op5_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op6_radix_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return remove_earlier_strings(_table(spark, folder, "documents"), digests=True)


def op7_column_generation(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), *_vocabulary("byte_bpe_50k.json"))


def op8_license_windows(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_table(spark, folder, "documents"))


def op9_sentencepiece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, folder, "documents"), *_vocabulary("byte_bpe_50k.tiktoken"), digests=True)


def op10_consensus_paths(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(_table(spark, folder, "pages"))


def op11_pivot_distances(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(_table(spark, folder, "embeddings"))


def op12_partenum_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(_table(spark, folder, "documents"))


def op13_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh id moves on to the next label, as its contract says."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, folder, "embeddings").withColumn("label", moved))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition_coverage,
        op2_circulant_minhash,
        op3_level_doubling,
        op4_secret_ledger,
        op5_pruned_graph,
        op6_radix_suffixes,
        op7_column_generation,
        op8_license_windows,
        op9_sentencepiece_bpe,
        op10_consensus_paths,
        op11_pivot_distances,
        op12_partenum_spelling,
        op13_threshold_negatives,
    )
}
#: The other operators' results (rolling hashes, digests, components, packing, tokens) are tested against brute force.
SQL = {
    "op8_license_windows": licenses.license_sql(),
    "op11_pivot_distances": topk.top_sql(),
    "op13_threshold_negatives": negatives.negatives_sql(),
}
