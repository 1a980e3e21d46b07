"""From raw documents to packed training sequences: five stages, each a table of its own.

Every stage takes the documents that the one before kept and returns the columns
of ``documents``, but for the last, which returns the packed pieces. ``run``
writes each stage to the shared scratch folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import packing, secrets
from logloom.llm.blocks import tidy
from logloom.llm.minhash import near_duplicates
from logloom.llm.quality import repetition_coverage
from logloom.llm.suffixes import remove_earlier_strings
from logloom.session import scratch_dir, written_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that is missing is null, further ones go."""
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(TYPES[c]).alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, with or without a doc_id. A null text has no words and is rejected."""
    docs = _documents(docs)
    # The columns go through the operator, so that no text is shuffled.
    return repetition_coverage(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; one without an id only where none has one.

    Where ids are null or shared, rows go by numbers instead, so that every row
    is a document of its own; of equally small ids one row stays.
    """
    docs = _documents(docs)
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept = near_duplicates(docs).where("kept").select("doc_id").hint("shuffle_hash")
        return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    rows = written_once(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    return rows.join(kept.select("row").hint("shuffle_hash"), "row", "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that an earlier one holds; one of which nothing is left goes.

    A removed run may cut a character in two; the rest of such a character goes too.
    """
    left = remove_earlier_strings(_documents(docs), carry=["lang", "source"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:], pa.array([len(t) for t in texts], pa.int64())],
                names=COLUMNS,
            )

    return left.where("n_removed < n_bytes").select("doc_id", "kept", "lang", "source").mapInArrow(
        tidy(whole), ", ".join(f"{c} {TYPES[c]}" for c in COLUMNS)
    ).where("trim(text) != ''")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret span replaced by a sign."""
    docs = _documents(docs)
    spans = secrets.scan(docs, scratch_dir(spark, "ledger")).where(F.size("findings") > 0).select("blob", "findings")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns))
            texts = get["text"].to_pylist()
            for i, found in enumerate(get.pop("findings").to_pylist()):
                if found:
                    texts[i] = secrets.mask(texts[i], [(f["start"], f["end"]) for f in found])
            get["text"] = pa.array(texts, pa.string())
            get["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([get[c] for c in COLUMNS], names=COLUMNS)

    # One row per content: rows that share an id may differ.
    spans = spans.dropDuplicates(["blob"]).hint("shuffle_hash")
    named = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    return named.join(spans, "blob", "left").select(*COLUMNS, "findings").mapInArrow(
        tidy(masked), ", ".join(f"{c} {TYPES[c]}" for c in COLUMNS)
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_documents(docs), path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secret_masking),
    ("packing", pack),
]

#: Rolling hashes, components and tokens are beyond SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
