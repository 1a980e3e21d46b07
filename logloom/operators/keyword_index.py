"""Which documents hold the words of a question, through postings of three-character runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..session import written_once
from ..sizing import is_small

#: Rarest runs of a word that are intersected before its documents are looked at.
RAREST = 3
#: Documents of a run in one part; a frequent run has many parts.
POSTINGS = 100_000
#: Rows of (text word, asked word) that are copied to every task.
COPIED = 50_000


def text_words(text: Column) -> Column:
    """The distinct runs of word characters in a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def text_grams(text: Column) -> Column:
    """Distinct runs of one to three word characters in a lower-cased text; a word that comes again has no further ones."""
    longest = F.array_distinct(F.regexp_extract_all(F.array_join(text_words(text), " "), F.lit("(?=([a-z0-9_]{1,3}))"), F.lit(1)))
    one, two = F.transform(longest, lambda g: F.substring(g, 1, 1)), F.transform(longest, lambda g: F.substring(g, 1, 2))
    return F.array_distinct(F.concat(longest, one, two))


def word_grams(word: Column) -> Column:
    """The runs that every text with the word holds: all of three characters, or the word itself if it is shorter."""
    runs = F.regexp_extract_all(word, F.lit("(?=([a-z0-9_]{3}))"), F.lit(1))
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.array_distinct(runs))


def gram_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``gram, item_id``: the index over whole texts; without a shuffle. Store it to search it more than once."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("item_id"), F.explode(text_grams(F.col(text))).alias("gram"))


def keyword_search(
    queries: DataFrame,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    postings: DataFrame | None = None,
    part_rows: int = POSTINGS,
) -> DataFrame:
    """Pairs ``query_id, item_id`` where any word of the query occurs in the document.

    A word may be part of a longer one and case does not matter. It consists of
    word characters, so it lies inside one word of a text that holds it. Without
    ``postings`` the distinct words of all texts are searched in place of the
    texts, and the documents of the words found are met by an equi-join.

    The postings (``gram_postings``; of whole texts if they are given) are
    counted first: of each word only the ``RAREST`` runs are met with their
    documents, and those that hold all of them are looked at once, each with all
    its words. The postings of a run with more than ``part_rows`` documents are
    dealt into parts. Texts are neither copied nor moved with a question.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(keywords(F.col("text")), F.lower))).alias("word"))
    asked = written_once(asked, "words")
    words = asked.select("word").distinct().select("word", F.explode(word_grams(F.col("word"))).alias("gram"))
    words = written_once(words, "grams")
    texts = docs.select(F.col(key).alias("item_id"), F.col(text).alias("_text")).where(F.col("item_id").isNotNull())
    if postings is None:
        held = texts.select("item_id", F.explode_outer(text_words(F.col("_text"))).alias("held")).where(F.col("held").isNotNull())
        vocabulary = written_once(held.select("held").distinct().select(F.col("held").alias("item_id"), F.col("held").alias("_text")), "vocabulary")
        wanted = words.select("gram").distinct()
        grams = written_once(gram_postings(vocabulary, "item_id", "_text").join(wanted, "gram", "left_semi"), "postings")
        inside = written_once(_holding(words, vocabulary, grams, part_rows).withColumnRenamed("item_id", "held"), "inside")
        found = held.join(F.broadcast(inside) if is_small(inside, COPIED) else inside, "held").select("item_id", "word").distinct()
    else:
        found = _holding(words, texts, postings, part_rows)
    return found.join(asked, "word").select("query_id", "item_id").distinct()


def _holding(words: DataFrame, texts: DataFrame, postings: DataFrame, part_rows: int) -> DataFrame:
    """``item_id, word`` of the texts that hold a word, by the postings of its rarest runs."""
    counts = postings.join(words.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("docs"))
    order = Window.partitionBy("word").orderBy("docs", "gram")
    # A run that no document holds leaves its word without documents.
    ranked = words.join(counts, "gram", "left").na.fill(0, ["docs"]).withColumn("at", F.row_number().over(order))
    rare = ranked.where(F.col("at") <= RAREST).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("docs") / part_rows)).cast("int"))
    rare = rare.withColumn("needed", F.count("*").over(Window.partitionBy("word"))).where(F.col("docs") > 0)
    # Frequent runs lie in as many parts as their number of documents asks for.
    parted = rare.select("gram", "word", "needed", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    split = rare.select("gram", "parts").distinct()
    dealt = postings.join(split, "gram").select("gram", "item_id", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"))
    met = dealt.join(parted, ["gram", "part"]).groupBy("item_id", "word").agg(F.count("*").alias("held"), F.first("needed").alias("needed"))
    # Rows that share a key may count a run twice; the text decides.
    candidates = met.where("held >= needed").groupBy("item_id").agg(F.collect_list("word").alias("words"))
    lowered = texts.select("item_id", F.lower("_text").alias("_text"))
    return lowered.join(candidates, "item_id").select(
        "item_id", F.explode(F.filter("words", lambda w: F.contains(F.col("_text"), w))).alias("word")
    )
