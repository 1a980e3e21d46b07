"""Secret scans over an incremental ledger of blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logloom.llm.blocks import blocks, tidy


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``needles``: a match holds one of these strings (small letters if ``fold``).

    A match counts if its group has at least ``least`` characters; a shorter one
    is dropped but still consumes its text. A changed rule takes a new version.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    needles: tuple[str, ...] = ()
    fold: bool = False

    @property
    def id(self) -> str:
        return f"{self.kind}/{self.version}"


BASE_RULES = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key"), True,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Public formats of keys and tokens, added to the base kinds.
RULES = BASE_RULES + (
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needles=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needles=("eyJ",)),
    Rule("hub_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", needles=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needles=("xox",)),
    Rule("cloud_key", 1, "AIza[0-9A-Za-z_-]{35}", needles=("AIza",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:[^\s/@]{1,256}@", needles=("://",)),
)

LEDGER = "blob string, rules array<string>, findings array<struct<start:int,rule:string,end:int>>"


def find(text: str, rules: Sequence[tuple[int, Rule, re.Pattern]]) -> list[tuple[int, int, str, int]]:
    """Spans (start, rank of the kind, kind, end) in code points, leftmost non-overlapping per kind."""
    small = text.lower() if any(rule.fold for _, rule, _ in rules) else ""
    found = []
    for rank, rule, pattern in rules:
        if rule.needles and not any(x in (small if rule.fold else text) for x in rule.needles):
            continue
        found += [
            (m.start(), rank, rule.kind, m.end())
            for m in pattern.finditer(text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least
        ]
    return sorted(found)


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings of every version (``keys``, text), scanning only what the ledger has not seen.

    A version is addressed by the SHA-256 of its content. The ledger, a Parquet
    folder that this call appends to, has a row per blob and call: the rule
    versions scanned and what each of them found. Pairs of blob and rule version
    found there are not scanned again; of versions with equal content one is
    scanned. What comes back are the ledger's findings of exactly the given rule
    versions, in the order of the given rules, joined to all versions of a blob,
    so thousands of copies cost one scan and a plain equi-join. Of the ledger
    only the rows of the blobs at hand are aggregated.

    Returns the keys, ``blob`` and ``findings`` (sorted by start, then by the
    rules' order). Texts are scanned whole, however long. A null text counts as an empty one; null keys and repeated
    rows keep their rows; an empty table appends nothing and returns no rows.
    """
    spark = versions.sparkSession
    ranked = [(i, rule, re.compile(rule.pattern, re.ASCII | (re.I if rule.fold else 0))) for i, rule in enumerate(rules)]
    keyed = versions.select(*keys, F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    every = F.array(*[F.lit(rule.id) for rule in rules])
    todo = keyed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("first")).withColumn("rules", every)
    before = read_ledger(spark, ledger)
    if before is not None:
        seen = before.join(todo.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = (
            todo.join(seen, "blob", "left")
            .withColumn("rules", F.array_except("rules", F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0)
        )
    one = todo.select(*[F.col("first")[k].alias(k) for k in keys], F.col("blob").alias("same"), "rules").hint("shuffle_hash")
    same = F.col("blob") == F.col("same")
    for k in keys:
        same &= keyed[k].eqNullSafe(one[k])
    unseen = keyed.join(one, same).select("blob", "text", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts, wanted = block.column("text").to_pylist(), block.column("rules").to_pylist()
            found = [
                [{"start": a, "rule": rules[rank].id, "end": b} for a, rank, _, b in find(t, [r for r in ranked if r[1].id in w])]
                for t, w in zip(texts, map(set, wanted))
            ]
            kind = pa.struct([("start", pa.int32()), ("rule", pa.string()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [block.column("blob"), pa.array(wanted, pa.list_(pa.string())), pa.array(found, pa.list_(kind))],
                names=["blob", "rules", "findings"],
            )

    # Repeated rows may bring one blob twice.
    unseen.mapInArrow(tidy(run), LEDGER).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    ids, kinds = F.array(*[F.lit(rule.id) for rule in rules]), F.array(*[F.lit(rule.kind) for rule in rules])
    rank = lambda f: F.array_position(ids, f["rule"])
    spans = F.transform(
        F.filter("findings", lambda f: F.array_contains(ids, f["rule"])),
        lambda f: F.struct(
            f["start"].alias("start"), (rank(f) - 1).cast("int").alias("rank"),
            F.element_at(kinds, rank(f).cast("int")).alias("kind"), f["end"].alias("end"),
        ),
    )
    known = (
        spark.read.schema(LEDGER).parquet(ledger).where(F.arrays_overlap("rules", ids))
        .join(keyed.select("blob").distinct(), "blob", "left_semi") if before is not None
        else spark.read.schema(LEDGER).parquet(ledger)
    )
    known = known.select("blob", spans.alias("findings")).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings")
    )
    return keyed.select(*keys, "blob").join(known, "blob").select(*keys, "blob", "findings")


def read_ledger(spark, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def mask(text: str, spans: Sequence[tuple[int, int]], sign: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``sign``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join(out) + text[at:]
