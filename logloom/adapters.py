"""Log-shaped views of the given ``events``, ``documents``, ``embeddings`` and ``conversations`` tables.

The tables hold no log text, so these views render it: one line per event row.
Every view is a plain projection or aggregation of whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.once import computed_once
from .functions.patterns import Template
from .operators.anomalies import above
from .operators.features import pivot_counts
from .operators.labels import join_training
from .operators.scoring import linear_score
from .schemas import DEFAULT_EVENTS

TEMPLATES: list[Template] = [
    ("E5", "Receiving block [*] src: [*] dest: [*]"),
    ("E7", "writeBlock [*] received exception [*]"),
    ("E9", "Received block [*] of size [*] from [*]"),
    ("E26", "BLOCK* NameSystem.addStoredBlock: blockMap updated: [*] is added to [*] size [*]"),
]

EVENT_CODES = {"click": "E5", "view": "E26", "purchase": "E9", "error": "E7"}

# Weights of the scoring rule used by the views: tenths, so that sums are exact.
WEIGHTS = {"E5": -4, "E7": 16, "E9": -5, "E26": -3}
BIAS = -6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """The same table as a file stream. The glob lets one file stand for a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/{name}.parque[t]")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _batch(ts: Column) -> Column:
    """The start of the row's day in epoch seconds."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") * 86400).cast("string")


def log_lines(events: DataFrame) -> DataFrame:
    """``line_no, ts, batch_id, line``: each event row as one log line."""
    block = _text("blk_", F.col("user_id").cast("string"))
    address = _text("/10.0.0.", (F.col("user_id") % 250).cast("string"))
    number = F.floor("value").cast("bigint").cast("string")
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", _text("Receiving block ", block, " src: ", address, " dest: ", address))
        .when(kind == "error", _text("writeBlock ", block, " received exception ", number))
        .when(kind == "purchase", _text("Received block ", block, " of size ", number, " from ", address))
        .when(
            kind == "view",
            _text(
                "BLOCK* NameSystem.addStoredBlock: blockMap updated: ", address, " is added to ", block,
                " size ", number,
            ),
        )
        .when(F.col("event_id") % 2 == 0, _text("request timeout for ", block))
        .otherwise(F.lit("session opened"))
    )
    prefix = _text(F.date_format("ts", "yyMMdd HHmmss"), " ", (F.col("event_id") % 1000).cast("string"))
    keep = [F.col("event_id").alias("line_no"), "ts", _batch(F.col("ts")).alias("batch_id")]
    return computed_once(events, keep, line=_text(prefix, " INFO store.Node: ", message))


def template_table(events: DataFrame) -> DataFrame:
    """``position, event_id, template``: a template for every user and every number, then the general ones.

    Those of a number have no whole word, and the last takes any line of some
    length, so lines match several and templates of every kind occur.
    """
    user, size = F.col("user_id").cast("string"), F.floor("value").cast("bigint")
    users = events.select((F.col("user_id") * 10 + 1).cast("bigint"), _text("U", user), _text("block blk_", user, " [*]"))
    sizes = events.select(size * 10 + 2, _text("S", size.cast("string")), _text("size ", size.cast("string"), "[*]"))
    halves = events.select(size * 10 + 3, _text("T", size.cast("string")), _text("size [*]", size.cast("string")))
    general = events.sparkSession.createDataFrame(
        [(10**9 + i, e, t) for i, (e, t) in enumerate([*TEMPLATES, ("E28", "e[*]7[*] "), ("E29", "[*]")])],
        "position long, event_id string, template string",
    )
    names = general.columns
    return users.toDF(*names).union(sizes.toDF(*names)).union(halves.toDF(*names)).distinct().union(general)


def _code() -> Column:
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_CODES.items()])


def coded_events(events: DataFrame) -> DataFrame:
    """``batch_id, block_id, event_id, ts`` of the rows that carry an event code."""
    return events.where(F.col("event_type").isin(list(EVENT_CODES))).select(
        _batch(F.col("ts")).alias("batch_id"),
        _text("blk_", F.col("user_id").cast("string")).alias("block_id"),
        _code().alias("event_id"),
        "ts",
    )


def block_event_stats(events: DataFrame) -> DataFrame:
    return (
        coded_events(events)
        .groupBy("batch_id", "block_id", "event_id")
        .agg(F.count("*").alias("cnt"), F.max("ts").alias("last_updated"))
    )


def event_counts(events: DataFrame) -> DataFrame:
    """The same counts as ``block_event_stats`` in rows that are not summed up yet, without a shuffle."""
    return coded_events(events).select(
        "batch_id", "block_id", "event_id", F.lit(1).cast("bigint").alias("cnt"), F.col("ts").alias("last_updated")
    )


def many_counts(events: DataFrame) -> DataFrame:
    """Counts of all 29 event kinds, one for every remainder of the row's id, in rows that are not summed up yet."""
    return events.select(
        _text("blk_", F.col("user_id").cast("string")).alias("block_id"),
        _text("E", (F.col("event_id") % 29 + 1).cast("string")).alias("event_id"),
        F.lit(1).cast("bigint").alias("cnt"),
        F.col("ts").alias("last_updated"),
    )


def many_anomalies(events: DataFrame) -> DataFrame:
    """A row for every block with all its event kinds, scored by its number."""
    wide = pivot_counts(many_counts(events), DEFAULT_EVENTS, extra=[F.max("last_updated").alias("detected_at")])
    number = F.substring("block_id", 5, 20).cast("bigint")
    return wide.withColumn("anomaly_score", F.round((number % 97) / F.lit(97.0), 6))


def block_labels(events: DataFrame) -> DataFrame:
    """Anomaly where more than 22 % of a user's events are errors; users whose newest event is a signup are unlabelled."""
    newest = F.max_by("event_type", F.struct("ts", "event_id"))
    users = events.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"), newest.alias("newest")
    )
    return users.where(F.col("newest") != "signup").select(
        _text("blk_", F.col("user_id").cast("string")).alias("block_id"),
        F.when(F.col("share") > 0.22, "Anomaly").otherwise("Normal").alias("label"),
    )


def score_expression() -> Column:
    total = " + ".join([*(f"{e} * {w}" for e, w in WEIGHTS.items()), str(BIAS)])
    return F.expr(f"round(1 / (1 + exp(-(({total}) / 10D))), 6)")


def scored_blocks(stats: DataFrame) -> DataFrame:
    """Features per (batch, block) with a score; one shuffle."""
    wide = pivot_counts(
        stats, DEFAULT_EVENTS, ("batch_id", "block_id"), [F.max("last_updated").alias("detected_at")]
    )
    return wide.withColumn("anomaly_score", score_expression())


def anomaly_blocks(stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    return above(scored_blocks(stats), threshold)


def labelled_training(events: DataFrame) -> DataFrame:
    """``block_id, label, target, E1..`` of the labelled blocks."""
    features = pivot_counts(event_counts(events), DEFAULT_EVENTS)
    labels = block_labels(events).withColumn(
        "label", F.when(F.col("label") == "Anomaly", "Fail").otherwise("Success")
    )
    return join_training(features, labels, DEFAULT_EVENTS)


def label_queries(embeddings: DataFrame) -> DataFrame:
    """One query per label: the mean vector of its members, and a question text."""
    values = embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = values.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding")
    ).select(
        F.col("label").alias("query_id"), _text("topic ", F.col("label").cast("string")).alias("text"), "embedding"
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("item_id"), "embedding")


def template_questions(spark: SparkSession) -> DataFrame:
    """One question per event template."""
    return spark.createDataFrame(TEMPLATES, "query_id string, text string")


def operator_messages(events: DataFrame) -> DataFrame:
    """A chat per user built from the event rows: commands, tags, confirmations, errors."""
    n = F.floor("value").cast("bigint").cast("string")
    kind = F.col("event_type")
    pick = F.col("event_id") % 4

    def choose(*texts: Column | str) -> Column:
        out = F.lit(texts[-1]) if isinstance(texts[-1], str) else texts[-1]
        for i in range(len(texts) - 2, -1, -1):
            out = F.when(pick == i, texts[i]).otherwise(out)
        return out

    text = (
        F.when(kind == "click", _text("查询过去", n, choose("小时", "分钟", "秒", "天")))
        .when(kind == "view", choose(_text("top", n, " 异常"), _text("前", n), "健康度", "紧急！导出数据？？？"))
        .when(
            kind == "purchase",
            choose(_text("INTENT: DATA | CONFIDENCE: 0.", n), "intent: monitor", "启动服务", "模型 batch "),
        )
        .when(kind == "error", choose("训练失败: timeout", "Connection refused", "请确认清理 Redis", "请确认重启服务"))
        .otherwise(choose("确认", "yes ", "删除配置", "请稍等！！"))
    )
    role = F.when(kind == "error", "assistant").otherwise("user")
    return events.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), text.alias("text")
    )


def duration_texts(events: DataFrame) -> DataFrame:
    """A time-range text per event row."""
    n = F.floor("value").cast("bigint").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", _text(n, "s"))
        .when(kind == "view", _text(" ", n, "M "))
        .when(kind == "purchase", _text(n, "h", n, "m15s"))
        .when(kind == "error", n)
        .otherwise(F.when(F.col("event_id") % 2 == 0, _text(n, "d")).otherwise(F.lit("")))
    )
    return events.select("event_id", text.alias("text"))


def knowledge_text(events: DataFrame) -> DataFrame:
    """One error-code text per event row with a code: a section and a table row."""
    code = _code()
    n = F.floor("value").cast("bigint").cast("string")
    level = F.when(F.col("value") > 50, "高").otherwise("中")
    text = _text(
        "## codes\n\n### ", code, ": ", F.col("event_type"), " ", n, "\n**严重程度**: ", level,
        "\n\n| ID | Type |\n| ", code, " | ", F.col("event_type"), " | ", level, " | check ", n, " |\n",
    )
    return events.where(F.col("event_type").isin(list(EVENT_CODES))).select("event_id", text.alias("text")).withColumnRenamed(
        "event_id", "doc_id"
    )


def event_meanings(spark: SparkSession) -> DataFrame:
    """A meaning per event code; an input table, since sources disagree on the meanings."""
    return spark.createDataFrame([(code, name) for name, code in EVENT_CODES.items()], "event_id string, meaning string")

