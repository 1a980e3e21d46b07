"""Registered queries that go by way of stored files, tables, models and streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters as ad
from .catalog import QUERIES, SQL, E, T4, _anom, _cols, _counts, _done, _DONE, _events, _lines, _stats, _sums, register
from .functions import patterns
from .operators import anomalies as an
from .operators import batches, features, labels, leaderboard, mining, ordering, scoring, training
from .plans import batch_jobs, model, reports
from .session import scratch_dir
from .sources import knowledge, tables
from .streaming import board as boards
from .streaming import jobs

__all__ = ["QUERIES", "SQL"]


def _score(frame: DataFrame) -> DataFrame:
    return frame.withColumn("anomaly_score", ad.score_expression())


# ---------------------------------------------------------------- sources


@register("stored_labels", "labels_", "SELECT block_id, label FROM labels_")
def stored_labels(spark, d):
    path = scratch_dir(spark, "labels")
    named = ad.block_labels(_events(spark, d)).select(F.col("block_id").alias("BlockId"), F.col("label").alias("Label"), F.lit(1).alias("other"))
    named.write.csv(path, header=True)
    return tables.project_labels(tables.read_labels(spark, path))


@register("first_source", "train", f"SELECT 'features' AS source, block_id, label, target, {_cols(T4)} FROM train")
def first_source(spark, d):
    """No matrix is there, the training table lacks its target, so features and labels are joined."""
    base, events = scratch_dir(spark, "sources"), _events(spark, d)
    wide = features.pivot_counts(_counts(spark, d), T4)
    wide.write.csv(f"{base}/features", header=True)
    wide.write.csv(f"{base}/training", header=True)
    known = ad.block_labels(events).withColumn("label", F.when(F.col("label") == "Anomaly", "Fail").otherwise("Success"))
    known.write.csv(f"{base}/labels", header=True)
    name, rows = tables.first_valid_source(
        spark, f"{base}/matrix", f"{base}/training", f"{base}/features", f"{base}/labels", event_ids=T4
    )
    return rows.select(F.lit(name).alias("source"), "block_id", "label", "target", *T4)


@register(
    "upload_counts",
    "feats",
    f"SELECT 'up1' AS batch_id, block_id, event_id, CAST(cnt AS BIGINT) AS cnt FROM (UNPIVOT (SELECT block_id, E5, E7 FROM feats) ON E5, E7 INTO NAME event_id VALUE cnt) WHERE cnt > 0",
)
def upload_counts(spark, d):
    path = scratch_dir(spark, "upload")
    wide = features.pivot_counts(_counts(spark, d), ["E5", "E7"])
    wide.withColumnRenamed("block_id", "BlockId").write.csv(path, header=True)
    return tables.read_upload(spark, path, "up1")


@register(
    "knowledge_files", "codes", "SELECT code AS event_id, event_type || ' ' || n AS title, level AS severity, count(*) AS sections FROM codes GROUP BY 1, 2, 3"
)
def knowledge_files(spark, d):
    path = scratch_dir(spark, "knowledge")
    ad.knowledge_text(_events(spark, d)).select("text").repartition(5).write.text(path)
    found = knowledge.error_sections(knowledge.read_knowledge(spark, path))
    return found.groupBy("event_id", "title", "severity").agg(F.count("*").alias("sections"))


@register("zeroed_features", "feats", f"SELECT block_id, {_cols(T4)} FROM feats")
def zeroed_features(spark, d):
    wide = features.pivot_counts(_counts(spark, d), T4)
    gaps = wide.withColumns({e: F.when(F.col(e) > 0, F.col(e)) for e in T4})
    return features.zero_missing(gaps, T4)


# ---------------------------------------------------------------- templates from the lines


_MINED = """words AS (SELECT line_no, line, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS i,
      len(string_split(line, ' ')) AS size FROM lines),
    fixed AS (SELECT size, i, w FROM words JOIN (SELECT size, count(DISTINCT line_no) AS al FROM words GROUP BY 1) USING (size)
      WHERE NOT regexp_matches(w, '[0-9]') GROUP BY size, i, w HAVING count(*) >= 2 AND count(*) >= 0.05 * any_value(al)),
    shaped AS (SELECT line_no, string_agg(CASE WHEN f.w IS NULL THEN '[*]' ELSE words.w END, ' ' ORDER BY words.i) AS template
      FROM words LEFT JOIN fixed f ON words.size = f.size AND words.i = f.i AND words.w = f.w GROUP BY 1),
    mined AS (SELECT row_number() OVER (ORDER BY count(*) DESC, template) AS position, template, count(*) AS lines FROM shaped
      GROUP BY template HAVING count(*) >= 2)"""


@register("mined_templates", "lines", f"SELECT * FROM (WITH {_MINED} SELECT position, 'M' || position AS event_id, template, lines FROM mined)")
def mined_templates(spark, d):
    return mining.mine_templates(_lines(spark, d))


@register(
    "mined_line_events",
    "lines",
    f"SELECT * FROM (WITH {_MINED} SELECT line_no, 'M' || position AS event_id FROM shaped JOIN mined USING (template))",
)
def mined_line_events(spark, d):
    """The lines under the templates that were mined from them."""
    lines = _lines(spark, d)
    found = [(r.event_id, r.template) for r in mining.mine_templates(lines).orderBy("position").collect()]
    return lines.select("line_no", patterns.first_match(F.col("line"), found).alias("event_id"))


# ---------------------------------------------------------------- blocks with many kinds of events


_MANY = f"""SELECT block_id, {', '.join(f"CAST(count(*) FILTER (WHERE event_id % 29 = {i}) AS BIGINT) AS E{i + 1}" for i in range(29))},
    max(ts) AS detected_at, round((any_value(user_id) % 97) / 97.0, 6) AS anomaly_score FROM ev GROUP BY 1"""
_KINDS = f"SELECT block_id, unnest({E}) AS event_id, unnest([{_cols(E)}]) AS cnt, unnest(range(29)) AS i FROM ({_MANY})"


@register(
    "top_five_of_many",
    "ev",
    f"""SELECT block_id, event_rank, event_id, cnt, CAST(floor(cnt * 10 / mx) AS INTEGER) AS bar FROM (
        SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY cnt DESC, i) AS event_rank, max(cnt) OVER (PARTITION BY block_id) AS mx
        FROM ({_KINDS}) WHERE cnt > 0) WHERE event_rank <= 5""",
)
def top_five_of_many(spark, d):
    rows = ad.many_anomalies(_events(spark, d)).select("block_id", *E)
    return an.top_events(rows, E, n=5)


@register(
    "dashboard_many",
    "ev",
    f"""SELECT m.block_id, anomaly_score AS probability, CASE WHEN anomaly_score > 0.8 THEN 'high' WHEN anomaly_score > 0.5 THEN 'medium' ELSE 'low' END AS severity,
        (SELECT string_agg(event_id || ':' || cnt, ' ' ORDER BY i) FROM (SELECT *, row_number() OVER (ORDER BY i) AS n FROM ({_KINDS}) k
         WHERE k.block_id = m.block_id AND cnt > 0) WHERE n <= 6) AS events,
        CAST(greatest((SELECT count(*) FROM ({_KINDS}) k WHERE k.block_id = m.block_id AND cnt > 0) - 6, 0) AS INTEGER) AS more, 'table' AS source
        FROM (SELECT * FROM ({_MANY}) ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 10) m""",
)
def dashboard_many(spark, d):
    events = _events(spark, d)
    report = reports.dashboard(ad.many_counts(events), ad.many_anomalies(events), hours=None)
    return report.rows.withColumn("events", features.event_text(F.col("events")))


@register(
    "anomaly_types_many",
    "ev labels_",
    f"""SELECT m.block_id, CASE WHEN l.label = 'Anomaly' THEN 'Fail' ELSE 'Success' END AS label,
        CASE WHEN l.label = 'Anomaly' THEN CASE WHEN E7 > 0 THEN 7 WHEN E21 > 0 THEN 21 WHEN E5 > 0 THEN 5 WHEN E4 > 0 THEN 4 ELSE 0 END END AS type
        FROM ({_MANY}) m LEFT JOIN labels_ l ON m.block_id = l.block_id""",
)
def anomaly_types_many(spark, d):
    events = _events(spark, d)
    typed = labels.with_default_labels(ad.many_anomalies(events), ad.block_labels(events), E)
    return typed.select("block_id", "label", "type")


@register(
    "export_board_rows",
    "board",
    f"SELECT block_id, anomaly_score, updated_at AS detected_at, {_cols(E)} FROM board ORDER BY anomaly_score DESC, block_id DESC LIMIT 10",
)
def export_board_rows(spark, d):
    anomalies = _anom(spark, d)
    return reports.export_anomalies(anomalies, leaderboard.leaderboard(anomalies))


@register("realtime_none", "stats", "SELECT 'none' AS source, 0 AS anomaly_count, count(DISTINCT event_id) AS kinds FROM stats")
def realtime_none(spark, d):
    """No board and no anomaly: the answer says so, beside the distribution of all events."""
    report = reports.realtime_anomalies(_stats(spark, d), _anom(spark, d).where("false"), None)
    kinds = report.distribution.agg(F.count("*").alias("kinds"))
    return report.summary.select("source", "anomaly_count", kinds.scalar().alias("kinds"))


@register(
    "drop_last_tied",
    "",
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS rn,
       count(*) OVER () AS n FROM events) WHERE rn <= n - n * 10 // 100""",
)
def drop_last_tied(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", "event_type")
    return ordering.drop_last_percent(rows, "user_id", 10, ties=["event_id"])


# ---------------------------------------------------------------- stored jobs


@register(
    "stored_anomalies",
    "anom",
    f"SELECT batch_id, block_id, {_cols(E)}, anomaly_score FROM anom WHERE batch_id NOT IN ({_DONE})",
)
def stored_anomalies(spark, d):
    """Pending batches are scored and stored once; the second round finds none, a named batch replaces itself."""
    base, stats = scratch_dir(spark, "offline"), _stats(spark, d)
    _done(stats).distinct().write.parquet(f"{base}/ledger")
    for _ in range(2):
        batch_jobs.process_offline_batches(stats, f"{base}/anomalies", f"{base}/ledger", _score)
    again = stats.agg(F.max("batch_id")).first()[0]
    batch_jobs.process_offline_batches(stats, f"{base}/anomalies", f"{base}/ledger", _score, batch_id=again)
    rows = spark.read.parquet(f"{base}/anomalies")
    return rows.select(F.col("batch_id").cast("string").alias("batch_id"), "block_id", *E, "anomaly_score")


_CUT = "TIMESTAMP '2024-01-20 00:00:00'"


@register(
    "incremental_rounds",
    "stats",
    f"SELECT max(last_updated) AS mark FROM stats WHERE last_updated <= {_CUT} UNION ALL SELECT max(last_updated) FROM stats",
)
def incremental_rounds(spark, d):
    """The marks of two rounds and of a third that finds nothing new."""
    base, stats = scratch_dir(spark, "online"), _stats(spark, d)
    start = stats.agg(F.expr("min(last_updated) - INTERVAL 1 DAY")).first()[0]
    early = stats.where(F.col("last_updated") <= F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    for rows in (early, stats, stats):
        batch_jobs.run_incremental(rows, f"{base}/anomalies", f"{base}/board", f"{base}/mark", _score, start)
    return spark.read.parquet(f"{base}/mark")


@register(
    "deleted_batches",
    "stats",
    """SELECT batch_id, table_no, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT batch_id, count(*) AS n FROM stats GROUP BY 1), (SELECT unnest([1, 2]) AS table_no)
       WHERE batch_id > (SELECT min(batch_id) FROM stats) GROUP BY 1, 2
       UNION ALL SELECT min(batch_id), t, -1 FROM stats, (SELECT unnest([1, 2]) AS t) GROUP BY 2""",
)
def deleted_batches(spark, d):
    """The first batch leaves two tables; its report counts as -1."""
    stats, names = _stats(spark, d), [f"batches_{uuid.uuid4().hex}" for _ in range(2)]
    for name in names:
        stats.write.partitionBy("batch_id").option("path", scratch_dir(spark, "batches")).saveAsTable(name)
    first = stats.agg(F.min("batch_id")).first()[0]
    report = batches.delete_batches(spark, names, [first], confirm=True)
    out = report.where("deleted").select(
        "batch_id", F.when(F.col("table_name") == names[0], 1).otherwise(2).alias("table_no"), F.lit(-1).cast("bigint").alias("rows")
    )
    for i, name in enumerate(names, 1):
        left = spark.table(name).groupBy(F.col("batch_id").cast("string").alias("batch_id")).agg(F.count("*").alias("rows"))
        out = out.unionByName(left.select("batch_id", F.lit(i).alias("table_no"), "rows"))
    return out


@register("deleted_all_batches", "stats", "SELECT batch_id, true AS deleted, 0 AS left_rows FROM stats GROUP BY 1")
def deleted_all_batches(spark, d):
    stats, name = _stats(spark, d), f"batches_{uuid.uuid4().hex}"
    stats.write.partitionBy("batch_id").option("path", scratch_dir(spark, "batches")).saveAsTable(name)
    report = batches.delete_all_batches(spark, [name], confirm=True)
    left = spark.table(name).count()
    return report.select("batch_id", "deleted", F.lit(left).alias("left_rows"))


@register("cleared_board", "board", f"SELECT block_id, anomaly_score, {_cols(E)}, 0 AS left_rows FROM board")
def cleared_board(spark, d):
    """A board of other scores is cleared before the right one is stored."""
    path, anomalies = scratch_dir(spark, "board"), _anom(spark, d)
    boards.update_board(spark, path, anomalies.withColumn("anomaly_score", F.col("anomaly_score") + 1), 1)
    boards.clear_board(spark, path, confirm=True)
    held = boards.read_board(spark, path)
    left = 0 if held is None else held.count()
    boards.update_board(spark, path, anomalies, 2)
    return boards.read_board(spark, path).select("block_id", "anomaly_score", *E, F.lit(left).alias("left_rows"))


# ---------------------------------------------------------------- streams


@register("dropped_files", "lines", "SELECT line, count(*) AS lines, true AS named FROM lines GROUP BY 1")
def dropped_files(spark, d):
    """Log files dropped into a folder in two lots, each file read once, two files to a trigger."""
    base = scratch_dir(spark, "drop")
    text = _lines(spark, d).select(F.concat(F.lit("  "), "line", F.lit(" \t")).alias("value"), "line_no")
    for part in (0, 1):
        text.where(F.col("line_no") % 2 == part).select("value").repartition(3).write.mode("append").text(f"{base}/in")
        lines = jobs.read_log_drop(spark, f"{base}/in", max_files=2)
        writer = lines.writeStream.format("parquet").option("path", f"{base}/out")
        jobs.start(spark, writer, f"{base}/cp").awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy("line").agg(F.count("*").alias("lines"), F.bool_and(F.col("batch_id").rlike("^online_[0-9]+$")).alias("named"))


@register("resumed_stream", "stats", f"SELECT block_id, {_sums(T4)} FROM stats GROUP BY 1")
def resumed_stream(spark, d):
    """A stream that is stopped and started again takes only what has come since; its last start finds nothing."""
    base, events = scratch_dir(spark, "resumed"), _events(spark, d)
    for part in (0, 1, None):
        if part is not None:
            events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        lines = ad.log_lines(spark.readStream.schema(events.schema).parquet(f"{base}/in")).withColumn("ts", F.col("ts").cast("timestamp"))
        counts = jobs.running_counts(jobs.matched_events(lines, ad.TEMPLATES), T4)
        jobs.write_updates(counts, f"{base}/out", f"{base}/cp").awaitTermination()
    return jobs.latest_counts(spark, f"{base}/out", T4).select("block_id", *T4)


@register(
    "progress_counters",
    "classed",
    """SELECT count(*) AS total, count(*) FILTER (WHERE match_type = 'template') AS template,
       count(*) FILTER (WHERE match_type = 'keyword_fallback') AS keyword_fallback,
       count(*) FILTER (WHERE type = 'anomaly') AS anomaly, count(*) FILTER (WHERE type = 'normal') AS normal,
       count(*) FILTER (WHERE type = 'unknown') AS unknown FROM classed""",
)
def progress_counters(spark, d):
    """The counters that the reports of a classifying stream carry, added up."""
    base, log, events = scratch_dir(spark, "progress"), jobs.ProgressLog(), _events(spark, d)
    total = events.count()
    spark.streams.addListener(log)
    try:
        raw = ad.stream_table(spark, d, "events")
        jobs.classify_stream(ad.log_lines(raw), ad.TEMPLATES, f"{base}/out", f"{base}/cp").awaitTermination()
        names = ["total", "template", "keyword_fallback", "anomaly", "normal", "unknown"]
        for _ in range(200):  # reports come a little after the stream's end
            found = [e["counters"]["counters"] for e in log.entries if e["counters"].get("counters")]
            if sum(f["total"] for f in found) >= total:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    return spark.createDataFrame([[int(sum(f[n] for f in found)) for n in names]], ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- models


@register("stored_model_scores", "train", "SELECT block_id, true AS same, true AS in_range, false AS trained_again FROM train")
def stored_model_scores(spark, d):
    """A model that is trained because there is none scores as the one that is read back."""
    path, rows = scratch_dir(spark, "model"), ad.labelled_training(_events(spark, d))
    first, _ = training.load_or_train(spark, path, lambda: rows, event_ids=E, iterations=5)
    second, again = training.load_or_train(spark, path, lambda: rows, event_ids=E, iterations=5)
    a = training.score_model(rows, first, E).select("block_id", F.col("anomaly_score").alias("a"))
    b = training.score_model(rows, second, E).select("block_id", F.col("anomaly_score").alias("b"))
    return a.join(b, "block_id").select(
        "block_id", (F.col("a") == F.col("b")).alias("same"), F.col("a").between(0, 1).alias("in_range"), F.lit(again).alias("trained_again")
    )


@register(
    "early_stopped_model",
    "split",
    """SELECT target, count(*) AS support, (SELECT count(*) FROM split WHERE part = 'test') AS cells, true AS learned,
       true AS stopped, true AS importance_agrees FROM split WHERE part = 'test' GROUP BY 1""",
)
def early_stopped_model(spark, d):
    """What a model trained to the point where a held-out part no longer gains must show, whatever the optimiser did."""
    rows = ad.labelled_training(_events(spark, d))
    made = model.train_and_evaluate(rows, early=training.EarlyStop())
    cells = made.confusion.first()
    flat, width = made.model.stages[-1].weights.toArray(), 64
    means = {e: float(abs(flat[i * width : (i + 1) * width]).mean()) for i, e in enumerate(E)}
    agrees = all(abs(means[r.feature] - r.importance) < 1e-12 for r in made.importance.collect())
    best = max(made.history)
    # The rounds after the best one are those that were waited for, or the rounds ran out.
    waited = len(made.history) - 1 - made.history.index(best)
    stopped = waited >= training.EarlyStop().patience or len(made.history) == training.EarlyStop().rounds
    major = max(cells.tn + cells.fp, cells.fn + cells.tp)
    learned = cells.tn + cells.tp >= 0.9 * major and best >= 0.5
    return made.report.select(
        "target", "support", F.lit(sum(cells)).cast("bigint").alias("cells"), F.lit(bool(learned)).alias("learned"),
        F.lit(bool(stopped)).alias("stopped"), F.lit(bool(agrees)).alias("importance_agrees"),
    )


def _full_net() -> scoring.Network:
    """A net of 29, 64, 32 and 1 nodes whose weights follow from their places."""
    sizes, layers = [29, 64, 32, 1], []
    for depth, (n, m) in enumerate(zip(sizes[:-1], sizes[1:])):
        matrix = tuple(tuple(((i * 7 + j * 13 + depth) % 11 - 5) / 40 for j in range(m)) for i in range(n))
        layers.append((matrix, tuple((j % 5 - 2) / 10 for j in range(m))))
    return scoring.Network(tuple(layers))


def _net_sql() -> str:
    """Layer by layer, each a list made of the list before it."""
    source = f"SELECT block_id, [{', '.join(f'CAST({e} AS DOUBLE)' for e in E)}] AS x FROM feats"
    for depth, nodes in enumerate([64, 32, 1]):
        total = f"(j % 5 - 2) / 10 + list_sum(list_transform(x, lambda v, i: v * (((i - 1) * 7 + j * 13 + {depth}) % 11 - 5) / 40))"
        node = total if depth == 2 else f"greatest({total}, 0)"
        source = f"SELECT block_id, list_transform(range({nodes}), lambda j: {node}) AS x FROM ({source})"
    return f"SELECT block_id, round(1 / (1 + exp(-x[1])), 6) AS score FROM ({source})"


@register("network_scores_full", "feats", _net_sql())
def network_scores_full(spark, d):
    wide = features.pivot_counts(_counts(spark, d), E)
    score = scoring.network_score([F.col(e) for e in E], _full_net())
    return wide.select("block_id", F.round(score, 6).alias("score"))
