"""Spelling variants of a corpus's words through partition-and-enumerate signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import written_once

#: Letters of a word, as a character class.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Parts that the elements of a letter multiset are dealt into; up to two of them are left out of a signature.
PARTS = 4
#: One run in so many loses a letter, as the contract's noise.
NOISE = 31


def corpus_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences, partly summed before the shuffle.

    Shorter runs are left out at once, since the noise only shortens them.
    """
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", run.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = F.expr("CAST(h % length(run) AS INT)")
    cut = F.concat(F.col("run").substr(F.lit(1), gone), F.col("run").substr(gone + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least_count
    )


def _signatures(words: DataFrame) -> DataFrame:
    """(key, side, word): words that are near share a key on sides 0 and 0 (one length) or 1 and 2 (a letter more).

    A word's vector has an element for the i-th occurrence of each letter. The
    hash of an element deals it into one of ``PARTS`` parts; a signature is the
    exclusive or of the parts that are not left out. A replaced letter changes
    two elements, so leaving out some two parts hides it; a letter more changes
    one. Keys also hold the length and the half of the word in which the two
    words agree letter by letter, since only one letter differs.
    """
    letters = F.array_distinct(F.split("word", ""))
    elements = F.flatten(
        F.transform(
            letters,
            lambda c: F.transform(
                F.sequence(F.lit(1), F.length("word") - F.length(F.replace(F.col("word"), c, F.lit("")))),
                lambda i: F.xxhash64(c, i),
            ),
        )
    )
    dealt = words.select("word", F.length("word").alias("size"), elements.alias("elements")).select(
        "word", "size",
        *[F.expr(f"aggregate(elements, 0L, (s, x) -> s ^ IF(pmod(x, {PARTS}) = {p}, x, 0L))").alias(f"part{p}") for p in range(PARTS)],
    )

    def rest(*left_out: int) -> Column:
        return F.expr(" ^ ".join(f"part{p}" for p in range(PARTS) if p not in left_out))

    keys = []

    def add(side: int, size: Column, half: Column, *left_out: int) -> None:
        first, second = F.col("word").substr(F.lit(1), half), F.col("word").substr(half + F.col("size") - size + 1, F.length("word"))
        for place, text in enumerate((first, second)):
            key = F.xxhash64(F.lit(min(side, 1)), size, F.lit(place), *map(F.lit, left_out), text, rest(*left_out))
            keys.append(F.struct(key.alias("key"), F.lit(side).cast("tinyint").alias("side")))

    size = F.col("size")
    for p in range(PARTS):
        for q in range(p):
            add(0, size, F.expr("size DIV 2").cast("int"), p, q)
        # For a letter more, both words are cut where the shorter one's length says.
        add(1, size, F.expr("(size + 1) DIV 2").cast("int"), p)
        add(2, size - 1, F.expr("size DIV 2").cast("int"), p)
    return dealt.select("word", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.side", "word")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs, both ways, that differ by exactly one inserted, deleted or replaced code point."""
    dealt = _signatures(words).repartition("key")
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & ((F.col("a.side") + F.col("b.side")) % 3 == 0)
        & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    )
    pairs = a.join(b.hint("merge"), meet).select(F.col("a.word").alias("word"), F.col("b.word").alias("near")).distinct()
    pairs = written_once(pairs, "pairs")
    return pairs.union(pairs.select("near", "word"))


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, noise: int = NOISE) -> DataFrame:
    """The words of ``docs`` (doc_id, text), the form that each is a variant of, and the root of its chain of forms.

    Words are maximal runs of letters, A-Z lower-cased, of at least
    ``least_length`` code points and ``least_count`` occurrences, after the
    noise that drops a letter from some runs. Two words are near if one code
    point is inserted, deleted or replaced. A word's form is its near word of
    largest n (ties: smallest in code-point order) if that n is ``times`` the
    word's own; the root follows forms to the last.

    Null and empty texts have no words; a null doc_id counts as an empty one in
    the noise; repeated rows count each; a word of any length is compared whole.
    An empty table gives an empty result. All steps are DataFrame functions:
    one aggregation over the runs, summed before the shuffle, then joins over
    distinct words alone, by keys of which adaptive execution splits hot ones.

    Returns word, form, root, n, n_near, form_n.
    """
    words = written_once(corpus_words(docs, least_length, least_count, noise), "words")
    counted = near_words(words).join(words.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near")
    # The largest n, then the smallest word.
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    strong = -F.col("best.minus") >= times * F.col("n")
    formed = written_once(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(_roots(formed.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): every round doubles how far a word looks along its chain; n grows along it, so chains are short."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written_once(
            now.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
