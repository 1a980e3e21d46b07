"""Registered queries over the given tables, each next to the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import intents, patterns, text as tx, tiers
from .operators import aggregates, anomalies as an, batches, chat, chunking, classify, features, keyword_index, labels
from .operators import leaderboard, ordering, retrieval, scoring, template_index, traces, training
from .plans import batch_jobs, conversations, knowledge, matrix, model, reports
from .schemas import DEFAULT_EVENTS
from .session import scratch_dir
from .sizing import lookup
from .sources import knowledge as know
from .sources import logs, numbering, sinks, tables
from .streaming import board as boards
from .streaming import details, jobs
from .streaming import row_windows as row_windows_

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared SQL

E = DEFAULT_EVENTS
T4 = ["E5", "E7", "E9", "E26"]


def _sums(ids: list[str]) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(cnt) FILTER (WHERE event_id = '{e}'), 0) AS BIGINT) AS {e}" for e in ids
    )


def _cols(ids: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{e}" for e in ids)


def _score(prefix: str = "") -> str:
    p = prefix
    return f"round(1 / (1 + exp(-(CAST(-4*{p}E5 + 16*{p}E7 - 5*{p}E9 - 3*{p}E26 - 6 AS DOUBLE) / 10))), 6)"


def _pairs(ids: list[str] = E, order: str = "i") -> str:
    """SQL text of the non-zero counts of a row, like ``E5:3 E7:1``."""
    items = ", ".join(f"{{'i': {i}, 'k': -{e}, 'e': '{e}', 'n': {e}}}" for i, e in enumerate(ids))
    listed = f"list_filter([{items}], lambda x: x.n > 0)"
    if order == "count":
        items = ", ".join(f"{{'k': -{e}, 'i': {i}, 'e': '{e}', 'n': {e}}}" for i, e in enumerate(ids))
        listed = f"list_sort(list_filter([{items}], lambda x: x.n > 0))"
    return f"array_to_string(list_transform({listed}, lambda x: x.e || ':' || x.n), ' ')"


CTE = {
    "ev": """SELECT *, 'blk_' || user_id AS block_id,
        CASE event_type WHEN 'click' THEN 'E5' WHEN 'view' THEN 'E26' WHEN 'purchase' THEN 'E9'
             WHEN 'error' THEN 'E7' END AS code,
        CAST(CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS VARCHAR) AS batch_id FROM events""",
    "lines": """SELECT event_id AS line_no, ts, batch_id,
        strftime(ts, '%y%m%d %H%M%S') || ' ' || (event_id % 1000) || ' INFO store.Node: ' ||
        CASE event_type
          WHEN 'click' THEN 'Receiving block ' || block_id || ' src: /10.0.0.' || (user_id % 250) || ' dest: /10.0.0.' || (user_id % 250)
          WHEN 'error' THEN 'writeBlock ' || block_id || ' received exception ' || CAST(floor(value) AS BIGINT)
          WHEN 'purchase' THEN 'Received block ' || block_id || ' of size ' || CAST(floor(value) AS BIGINT) || ' from /10.0.0.' || (user_id % 250)
          WHEN 'view' THEN 'BLOCK* NameSystem.addStoredBlock: blockMap updated: /10.0.0.' || (user_id % 250) || ' is added to ' || block_id || ' size ' || CAST(floor(value) AS BIGINT)
          ELSE CASE WHEN event_id % 2 = 0 THEN 'request timeout for ' || block_id ELSE 'session opened' END
        END AS line FROM ev""",
    "matched": """SELECT line_no, ts, batch_id, line,
        nullif(regexp_extract(line, '(blk_[-0-9]+)', 1), '') AS block_id,
        CASE WHEN line LIKE '%Receiving block % src: % dest: %' THEN 'E5'
             WHEN line LIKE '%writeBlock % received exception %' THEN 'E7'
             WHEN line LIKE '%Received block % of size % from %' THEN 'E9'
             WHEN line LIKE '%BLOCK* NameSystem.addStoredBlock: blockMap updated: % is added to % size %' THEN 'E26'
        END AS event_id FROM lines""",
    "classed": """SELECT line_no, line, m AS match_type,
        CASE WHEN m = 'keyword_fallback' THEN 'E_UNKNOWN_ERR' ELSE event_id END AS event_id,
        CASE WHEN m = 'unknown' THEN 'unknown' WHEN m = 'keyword_fallback' OR event_id = 'E7' THEN 'anomaly' ELSE 'normal' END AS type,
        CASE WHEN m = 'keyword_fallback' OR event_id = 'E7'
             THEN coalesce(nullif(regexp_extract(line, '(blk[-_]?-?[0-9]+)', 1), ''), 'unknown') END AS block_id
        FROM (SELECT *, CASE WHEN event_id IS NOT NULL THEN 'template'
             WHEN regexp_matches(line, '(?i)ERROR|FATAL|CRITICAL|Exception|Failed|Corrupt|timeout|unavailable|invalid') THEN 'keyword_fallback'
             ELSE 'unknown' END AS m FROM matched)""",
    "stats": """SELECT batch_id, block_id, code AS event_id, count(*) AS cnt, max(ts) AS last_updated
        FROM ev WHERE code IS NOT NULL GROUP BY 1, 2, 3""",
    "labels_": """SELECT 'blk_' || user_id AS block_id,
        CASE WHEN CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) > 0.22
             THEN 'Anomaly' ELSE 'Normal' END AS label
        FROM events GROUP BY user_id HAVING last(event_type ORDER BY ts, event_id) <> 'signup'""",
    "feats": f"SELECT block_id, {_sums(E)} FROM stats GROUP BY 1",
    "scored": f"SELECT *, {_score()} AS anomaly_score FROM (SELECT batch_id, block_id, {_sums(E)}, max(last_updated) AS detected_at FROM stats GROUP BY 1, 2)",
    "anom": "SELECT * FROM scored WHERE anomaly_score > 0.5",
    "moment": "SELECT max(ts) AS t FROM events",
    "train": f"""SELECT f.block_id, CASE WHEN l.label = 'Anomaly' THEN 'Fail' ELSE 'Success' END AS label,
        CASE WHEN l.label = 'Anomaly' THEN 1 ELSE 0 END AS target, {_cols(E, 'f.')}
        FROM feats f JOIN labels_ l ON f.block_id = l.block_id""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id
        ORDER BY anomaly_score DESC, detected_at DESC, batch_id DESC) AS rn FROM anom) WHERE rn = 1""",
    "newest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id
        ORDER BY detected_at DESC, anomaly_score DESC) AS rn FROM anom) WHERE rn = 1""",
    "board": f"""SELECT block_id, anomaly_score, {_cols(E)}, detected_at AS updated_at,
        detected_at + INTERVAL 3600 SECOND AS expires_at FROM newest ORDER BY anomaly_score DESC, block_id DESC LIMIT 10""",
    "split": """SELECT *, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || block_id), block_id) AS rk,
         CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS n FROM train)""",
    "msgs": """SELECT user_id AS conv_id, event_id AS turn, CASE WHEN event_type = 'error' THEN 'assistant' ELSE 'user' END AS role,
        CASE event_type
          WHEN 'click' THEN '查询过去' || CAST(floor(value) AS BIGINT) || CASE event_id % 4 WHEN 0 THEN '小时' WHEN 1 THEN '分钟' WHEN 2 THEN '秒' ELSE '天' END
          WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'top' || CAST(floor(value) AS BIGINT) || ' 异常' WHEN 1 THEN '前' || CAST(floor(value) AS BIGINT) WHEN 2 THEN '健康度' ELSE '紧急！导出数据？？？' END
          WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'INTENT: DATA | CONFIDENCE: 0.' || CAST(floor(value) AS BIGINT) WHEN 1 THEN 'intent: monitor' WHEN 2 THEN '启动服务' ELSE '模型 batch ' END
          WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN '训练失败: timeout' WHEN 1 THEN 'Connection refused' WHEN 2 THEN '请确认清理 Redis' ELSE '请确认重启服务' END
          ELSE CASE event_id % 4 WHEN 0 THEN '确认' WHEN 1 THEN 'yes ' WHEN 2 THEN '删除配置' ELSE '请稍等！！' END
        END AS text FROM events""",
    "queries_": """SELECT label AS query_id, list(x ORDER BY i) AS q FROM (
        SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, len(embedding) + 1) AS r(i)
        GROUP BY label, i) GROUP BY label""",
    "ranked": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
        SELECT query_id, vec_id AS item_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS s
        FROM queries_, embeddings)) WHERE rank <= 3""",
    "codes": """SELECT event_id AS doc_id, code, event_type, CAST(floor(value) AS BIGINT) AS n,
        CASE WHEN value > 50 THEN '高' ELSE '中' END AS level FROM ev WHERE code IS NOT NULL""",
}

NEEDS = {
    "lines": ["ev"], "matched": ["lines"], "classed": ["matched"], "stats": ["ev"], "feats": ["stats"],
    "scored": ["stats"], "anom": ["scored"], "train": ["feats", "labels_"], "best": ["anom"],
    "newest": ["anom"], "board": ["newest"], "split": ["train"], "ranked": ["queries_"], "codes": ["ev"],
}


def _with(names: str, body: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in done)
    return f"WITH {ctes} {body}" if ctes else body


def register(name: str, ctes: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL over named parts; without SQL it is checked by tests only."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _with(ctes, sql)
        return fn

    return add


# ---------------------------------------------------------------- inputs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "events")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ad.log_lines(_events(spark, d))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return ad.block_event_stats(_events(spark, d))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts for queries that sum them anyway."""
    return ad.event_counts(_events(spark, d))


def _anom(spark: SparkSession, d: str) -> DataFrame:
    return ad.anomaly_blocks(_counts(spark, d))


def _asof(spark: SparkSession, d: str):
    return an.latest(_events(spark, d), "ts")


def _pair_text(events: str = "events"):
    return features.event_text(F.col(events)).alias("events")


# ---------------------------------------------------------------- lines and matrix


_MATRIX = f"""SELECT m.block_id, CASE WHEN any_value(l.label) = 'Anomaly' THEN 'Fail' ELSE 'Success' END AS label,
        CASE WHEN any_value(l.label) = 'Anomaly' THEN CASE WHEN count(*) FILTER (WHERE event_id = 'E7') > 0 THEN 7
             WHEN count(*) FILTER (WHERE event_id = 'E5') > 0 THEN 5 ELSE 0 END END AS type,
        {', '.join(f"count(*) FILTER (WHERE event_id = '{e}') AS {e}" for e in T4)}
        FROM matched m LEFT JOIN labels_ l ON m.block_id = l.block_id WHERE m.block_id IS NOT NULL GROUP BY 1"""


@register("event_matrix", "matched labels_", _MATRIX)
def event_matrix(spark, d):
    return matrix.build_matrix(_lines(spark, d), ad.TEMPLATES, ad.block_labels(_events(spark, d)))


@register("matrix_files", "matched labels_", _MATRIX)
def matrix_files(spark, d):
    """The same matrix by way of files: log text in, matrix stored and read back."""
    log, stored = scratch_dir(spark, "log"), scratch_dir(spark, "matrix")
    _lines(spark, d).select("line").write.text(log)
    built = matrix.build_matrix(logs.read_log_lines(spark, log), ad.TEMPLATES, ad.block_labels(_events(spark, d)))
    sinks.write_matrix(built, stored, "csv")
    return tables.read_matrix(spark, stored, T4).withColumn("type", F.col("type").cast("int"))


@register("line_classification", "classed", "SELECT line_no, match_type, event_id, type, block_id FROM classed")
def line_classification(spark, d):
    out = classify.classify_lines(_lines(spark, d), ad.TEMPLATES)
    return out.select("line_no", "match_type", "event_id", "type", "block_id")


@register(
    "line_classification_templates_only",
    "matched",
    """SELECT line_no, CASE WHEN event_id IS NULL THEN 'unknown' ELSE 'template' END AS match_type, event_id,
       CASE WHEN event_id IS NULL THEN 'unknown' WHEN event_id = 'E7' THEN 'anomaly' ELSE 'normal' END AS type,
       CASE WHEN event_id = 'E7' THEN block_id END AS block_id FROM matched""",
)
def line_classification_templates_only(spark, d):
    out = classify.classify_lines(_lines(spark, d), ad.TEMPLATES, keyword_fallback=False)
    return out.select("line_no", "match_type", "event_id", "type", "block_id")


@register(
    "match_counters",
    "classed",
    """SELECT count(*) AS total, count(*) FILTER (WHERE match_type = 'template') AS template,
       count(*) FILTER (WHERE match_type = 'keyword_fallback') AS keyword_fallback,
       count(*) FILTER (WHERE type = 'anomaly') AS anomaly, count(*) FILTER (WHERE type = 'normal') AS normal,
       count(*) FILTER (WHERE type = 'unknown') AS unknown, count(*) FILTER (WHERE match_type <> 'unknown') AS matched
       FROM classed""",
)
def match_counters(spark, d):
    return classify.match_counters(classify.classify_lines(_lines(spark, d), ad.TEMPLATES))


@register("unknown_lines", "classed", "SELECT line_no, line, match_type FROM classed WHERE match_type <> 'template'")
def unknown_lines(spark, d):
    out = classify.unmatched_lines(classify.classify_lines(_lines(spark, d), ad.TEMPLATES))
    return out.select("line_no", "line", "match_type")


@register(
    "split_line_files",
    "lines",
    """SELECT (n - 1) // 70 AS file_no, (n - 1) % 70 AS place, line_no FROM
       (SELECT line_no, row_number() OVER (ORDER BY line_no) AS n FROM lines)""",
)
def split_line_files(spark, d):
    """Lines in files by their number, cut into files of 70 lines, and read again."""
    source, cut = scratch_dir(spark, "log"), scratch_dir(spark, "split")
    lines = _lines(spark, d).select(F.concat_ws(" ", "line_no", "line").alias("value"), "line_no").repartitionByRange(5, "line_no")
    lines.sortWithinPartitions("line_no").select("value").write.text(source)
    sinks.split_files(spark, source, cut, 70)
    read = numbering.numbered(spark.read.text(cut), "n", once=True)
    first = F.min("n").over(Window.partitionBy("file_no"))
    number = F.substring_index("value", " ", 1).cast("long")
    return read.select(F.col("file_no").cast("long").alias("file_no"), (F.col("n") - first).alias("place"), number.alias("line_no"))


@register("truncated_documents", "", "SELECT doc_id, substr(text, 1, 200) AS head FROM documents")
def truncated_documents(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", tx.truncate(F.col("text"), 200).alias("head"))


@register("line_events", "matched", "SELECT line_no, event_id FROM matched WHERE event_id IS NOT NULL")
def line_events(spark, d):
    found = F.explode(patterns.all_matches(F.col("line"), ad.TEMPLATES))
    return _lines(spark, d).select("line_no", found.alias("event_id"))


@register("line_events_by_word", "matched", "SELECT line_no, event_id FROM matched WHERE event_id IS NOT NULL")
def line_events_by_word(spark, d):
    table = spark.createDataFrame(ad.TEMPLATES, "event_id string, template string")
    return classify.match_by_anchor(_lines(spark, d), table, "line_no")


# A template table of some thousand rows: of a user, of a number (twice), the general ones, and two that have no word.
CTE["hits"] = """SELECT line_no, user_id * 10 + 1 AS position, 'U' || user_id AS event_id FROM matched JOIN
    (SELECT DISTINCT user_id FROM events) ON contains(line, 'block blk_' || user_id || ' ')
    UNION ALL SELECT line_no, n * 10 + 2, 'S' || n FROM matched JOIN numbers ON contains(line, 'size ' || n)
    UNION ALL SELECT line_no, n * 10 + 3, 'T' || n FROM matched JOIN numbers ON line LIKE '%size %' || n || '%'
    UNION ALL SELECT line_no, 1000000000 + CASE event_id WHEN 'E5' THEN 0 WHEN 'E7' THEN 1 WHEN 'E9' THEN 2 ELSE 3 END, event_id
    FROM matched WHERE event_id IS NOT NULL
    UNION ALL SELECT line_no, 1000000004, 'E28' FROM matched WHERE line LIKE '%e%7% %'
    UNION ALL SELECT line_no, 1000000005, 'E29' FROM matched"""
CTE["numbers"] = "SELECT DISTINCT CAST(floor(value) AS BIGINT) AS n FROM events"
CTE["firsts"] = "SELECT line_no, arg_min(event_id, position) AS event_id FROM hits WHERE event_id <> 'E29' GROUP BY 1"
NEEDS |= {"hits": ["matched", "numbers"], "firsts": ["hits"]}


@register("template_table_matches", "hits", "SELECT line_no, position, event_id FROM hits")
def template_table_matches(spark, d):
    table = ad.template_table(_events(spark, d))
    return template_index.indexed_matches(_lines(spark, d), table, "line_no")


def _template_file(spark, d):
    """The template table, without the one that takes any line, by way of a file; positions are places in it."""
    path = scratch_dir(spark, "templates")
    table = ad.template_table(_events(spark, d)).where("event_id <> 'E29'").orderBy("position")
    table.select(F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate")).write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return logs.load_templates(spark, path, limit=100)


@register("template_table_first", "firsts", "SELECT line_no, event_id FROM firsts")
def template_table_first(spark, d):
    return template_index.first_matches(_lines(spark, d), _template_file(spark, d), "line_no")


@register(
    "template_table_classes",
    "firsts",
    """SELECT line_no, m AS match_type, CASE WHEN m = 'keyword_fallback' THEN 'E_UNKNOWN_ERR' ELSE event_id END AS event_id,
       CASE WHEN m = 'unknown' THEN 'unknown' WHEN m = 'keyword_fallback' OR event_id IN ('E7', 'E28') THEN 'anomaly' ELSE 'normal' END AS type,
       CASE WHEN m = 'keyword_fallback' OR event_id IN ('E7', 'E28')
            THEN coalesce(nullif(regexp_extract(line, '(blk[-_]?-?[0-9]+)', 1), ''), 'unknown') END AS block_id
       FROM (SELECT l.line_no, line, f.event_id, CASE WHEN f.event_id IS NOT NULL THEN 'template'
             WHEN regexp_matches(line, '(?i)ERROR|FATAL|CRITICAL|Exception|Failed|Corrupt|timeout|unavailable|invalid') THEN 'keyword_fallback'
             ELSE 'unknown' END AS m FROM lines l LEFT JOIN firsts f ON l.line_no = f.line_no)""",
)
def template_table_classes(spark, d):
    out = classify.classify_lines(_lines(spark, d), _template_file(spark, d), key="line_no")
    return out.select("line_no", "match_type", "event_id", "type", "block_id")


@register(
    "template_table_counts",
    "hits labels_",
    """SELECT b.block_id, CASE WHEN l.label = 'Anomaly' THEN 'Fail' ELSE 'Success' END AS label, c.event_id,
       coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT block_id FROM matched WHERE block_id IS NOT NULL) b
       LEFT JOIN (SELECT block_id, h.event_id, count(*) AS cnt FROM hits h JOIN matched m ON h.line_no = m.line_no
       WHERE h.event_id NOT LIKE 'U%' AND h.event_id NOT IN ('E28', 'E29') GROUP BY 1, 2) c ON b.block_id = c.block_id
       LEFT JOIN labels_ l ON b.block_id = l.block_id""",
)
def template_table_counts(spark, d):
    events = _events(spark, d)
    table = ad.template_table(events).where("event_id NOT LIKE 'U%' AND event_id NOT IN ('E28', 'E29')")
    return matrix.build_counts(_lines(spark, d), table, ad.block_labels(events), "line_no")


@register(
    "block_ids",
    "lines",
    """SELECT line_no, nullif(regexp_extract(line, '(blk_[-0-9]+)', 1), '') AS strict_id,
       coalesce(nullif(regexp_extract(line, '(blk[-_]?-?[0-9]+)', 1), ''), 'unknown') AS lenient_id FROM lines""",
)
def block_ids(spark, d):
    line = F.col("line")
    return _lines(spark, d).select(
        "line_no", tx.block_id(line).alias("strict_id"), tx.block_id(line, lenient=True).alias("lenient_id")
    )


def _messages(spark, d):
    lines = _lines(spark, d)
    encoded = logs.encode_batched(F.col("batch_id"), F.concat(F.lit("  "), "line", F.lit("\r")))
    return logs.decode_batched(lines.select(encoded.alias("value")))


@register("batched_messages", "lines", "SELECT batch_id, line FROM lines")
def batched_messages(spark, d):
    return _messages(spark, d)


@register(
    "ingested_stats",
    "matched",
    """SELECT batch_id, block_id, event_id, count(*) AS cnt, max(date_trunc('second', ts)) AS last_updated
       FROM matched WHERE block_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2, 3""",
)
def ingested_stats(spark, d):
    return matrix.ingest_messages(_messages(spark, d), ad.TEMPLATES)


@register("wide_messages", "stats", "SELECT batch_id, block_id, event_id, cnt FROM stats")
def wide_messages(spark, d):
    wide = features.pivot_counts(_counts(spark, d), E, ("batch_id", "block_id"))
    sent = wide.select(F.to_json(F.struct("batch_id", "block_id", *T4)).alias("value"))
    return features.unpivot_counts(logs.decode_wide(sent), E)


@register("block_features", "feats", "SELECT * FROM feats")
def block_features(spark, d):
    return features.pivot_counts(_counts(spark, d), E)


@register("long_counts", "stats", "SELECT block_id, event_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM stats GROUP BY 1, 2")
def long_counts(spark, d):
    return features.unpivot_counts(features.pivot_counts(_counts(spark, d), E), E)


@register(
    "event_arrays",
    "feats",
    f"SELECT block_id, {_pairs()} AS by_event, {_pairs(order='count')} AS by_count FROM feats",
)
def event_arrays(spark, d):
    wide = features.pivot_counts(_counts(spark, d), E)
    return wide.select(
        "block_id",
        features.event_text(features.event_array(E)).alias("by_event"),
        features.event_text(features.event_array(E, by_count=True)).alias("by_count"),
    )


@register(
    "event_lines",
    "feats",
    "SELECT block_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {e} > 0 THEN '{e}: {t} (出现 ' || {e} || ' 次)' END" for e, t in ad.TEMPLATES)
    + "], lambda x: x IS NOT NULL), '\n') AS events FROM feats",
)
def event_lines(spark, d):
    wide = features.pivot_counts(_counts(spark, d), E)
    return wide.select("block_id", features.event_lines(features.event_array(E), ad.TEMPLATES).alias("events"))


@register("training_set", "train", "SELECT * FROM train")
def training_set(spark, d):
    return ad.labelled_training(_events(spark, d))


@register(
    "matrix_diff",
    "matched",
    """SELECT (SELECT count(DISTINCT block_id) FROM matched WHERE block_id IS NOT NULL) AS common_blocks, event_id, mismatches FROM (
       SELECT unnest(['E5', 'E7', 'E9', 'E26', 'total']) AS event_id, unnest([0, 0, 0, n, n]) AS mismatches FROM
       (SELECT count(DISTINCT block_id) AS n FROM matched WHERE event_id = 'E26'))""",
)
def matrix_diff(spark, d):
    lines = _lines(spark, d)
    literal = features.block_event_matrix(lines, ad.TEMPLATES)
    raw = features.block_event_matrix(lines, ad.TEMPLATES, mode="raw")
    return matrix.compare_matrices(literal, raw, T4)


@register("class_balance", "train", "SELECT target, count(*) AS rows FROM train GROUP BY 1")
def class_balance(spark, d):
    return labels.class_balance(ad.labelled_training(_events(spark, d)))


@register(
    "label_encoding",
    "labels_",
    """SELECT block_id, CASE label WHEN 'Anomaly' THEN 'Fail' ELSE 'Success' END AS label,
       CASE label WHEN 'Anomaly' THEN 1 ELSE 0 END AS target FROM labels_""",
)
def label_encoding(spark, d):
    coded = F.when(F.col("label") == "Anomaly", "Fail").otherwise("Success")
    known = ad.block_labels(_events(spark, d)).select("block_id", tiers.label_target(coded).alias("target"))
    return known.select("block_id", tiers.target_label(F.col("target")).alias("label"), "target")


@register("first_blocks", "feats", f"SELECT block_id, {_cols(T4)} FROM feats ORDER BY block_id LIMIT 25")
def first_blocks(spark, d):
    wide = features.pivot_counts(_counts(spark, d), T4)
    return ordering.first_rows(wide, 25, ["block_id"])


@register(
    "drop_last_pct",
    "",
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn,
       count(*) OVER () AS n FROM events) WHERE rn <= n - n * 10 // 100""",
)
def drop_last_pct(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", "event_type")
    return ordering.drop_last_percent(rows, "event_id", 10)


# ---------------------------------------------------------------- reports


@register("event_distribution", "stats", "SELECT event_id, CAST(sum(cnt) AS BIGINT) AS total_count FROM stats GROUP BY 1")
def event_distribution(spark, d):
    return aggregates.event_distribution(_counts(spark, d))


@register(
    "event_distribution_recent",
    "stats moment",
    """SELECT event_id, CAST(sum(cnt) AS BIGINT) AS total_count FROM stats
       WHERE last_updated >= (SELECT t FROM moment) - INTERVAL 36 HOUR GROUP BY 1""",
)
def event_distribution_recent(spark, d):
    recent = an.since(_stats(spark, d), "last_updated", _asof(spark, d), an.range_seconds(hours=36))
    return aggregates.event_distribution(recent)


@register("total_blocks", "stats", "SELECT count(DISTINCT block_id) AS total_blocks FROM stats")
def total_blocks(spark, d):
    return aggregates.total_blocks(_counts(spark, d))


@register(
    "recent_anomalies",
    "anom moment",
    f"""SELECT block_id, anomaly_score, detected_at, {_pairs()} AS events FROM anom
        WHERE detected_at >= (SELECT t FROM moment) - INTERVAL 24 HOUR
        ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 100""",
)
def recent_anomalies(spark, d):
    rows = reports.recent_anomalies(_anom(spark, d), hours=24, as_of=_asof(spark, d))
    return rows.withColumn("events", _pair_text())


@register(
    "query_anomalies",
    "anom moment",
    f"""SELECT block_id, anomaly_score, detected_at, {_pairs()} AS events FROM anom
        WHERE detected_at >= (SELECT t FROM moment) - INTERVAL 10 DAY
        ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 50""",
)
def query_anomalies(spark, d):
    report = reports.query_anomalies(_stats(spark, d), _anom(spark, d), limit=50, days=10, as_of=_asof(spark, d))
    return report.rows.withColumn("events", _pair_text())


_SUMMARY = """SELECT (SELECT count(DISTINCT block_id) FROM stats) AS total_blocks, count(DISTINCT block_id) AS anomaly_count,
       count(*) AS hits FROM anom WHERE detected_at >= (SELECT t FROM moment) - INTERVAL {hours} HOUR"""


@register(
    "analyze_summary",
    "stats anom moment",
    f"""SELECT total_blocks, anomaly_count, least(hits, 100) AS listed_count,
        round(anomaly_count / total_blocks, 4) AS anomaly_ratio, round(least(hits, 100) / total_blocks, 4) AS listed_ratio
        FROM ({_SUMMARY.format(hours=72)})""",
)
def analyze_summary(spark, d):
    return reports.analysis_summary(_counts(spark, d), _anom(spark, d), _asof(spark, d), 72 * 3600)


@register(
    "analyze_top",
    "anom moment",
    f"""SELECT block_id, anomaly_score AS probability, CASE WHEN anomaly_score > 0.5 THEN 'anomaly' ELSE 'normal' END AS label,
        {_pairs(order='count')} AS events FROM anom WHERE detected_at >= (SELECT t FROM moment) - INTERVAL 1 HOUR
        ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 10""",
)
def analyze_top(spark, d):
    return reports.analyze(_stats(spark, d), _anom(spark, d), _asof(spark, d)).rows.withColumn("events", _pair_text())


@register(
    "health",
    "stats anom moment",
    f"""SELECT total_blocks, anomaly_count, p AS health_percent,
        CASE WHEN p < 80 THEN 'attention' WHEN p < 95 THEN 'good' ELSE 'excellent' END AS status FROM
        (SELECT *, round((1 - anomaly_count / total_blocks) * 100, 1) AS p FROM ({_SUMMARY.format(hours=24)}))""",
)
def health(spark, d):
    return reports.system_health(_counts(spark, d), _anom(spark, d), _asof(spark, d), 24 * 3600)


_RISK = "CASE WHEN row_count > 50 THEN 'high' WHEN row_count > 20 THEN 'medium' ELSE 'normal' END AS risk"
_BATCHES = f"""SELECT *, strftime(make_timestamp(CAST(batch_id AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') AS batch_time, {_RISK} FROM
    (SELECT batch_id, count(*) AS row_count, count(DISTINCT block_id) AS block_count,
     min(last_updated) AS first_seen, max(last_updated) AS last_seen FROM stats GROUP BY 1)"""


@register("batch_list", "stats", f"{_BATCHES} ORDER BY batch_id DESC LIMIT 10")
def batch_list(spark, d):
    return batch_jobs.list_batches(_stats(spark, d))


@register(
    "batch_totals",
    "stats",
    """SELECT count(*) AS batches, CAST(sum(r) AS BIGINT) AS total_rows, CAST(sum(b) AS BIGINT) AS total_blocks FROM
       (SELECT count(*) AS r, count(DISTINCT block_id) AS b FROM stats GROUP BY batch_id)""",
)
def batch_totals(spark, d):
    return aggregates.batch_totals(aggregates.batch_list(_stats(spark, d), None))


@register(
    "batch_report",
    "stats anom",
    """SELECT s.*, coalesce(a.anomaly_count, 0) AS anomaly_count FROM
       (SELECT batch_id, count(*) AS row_count, min(last_updated) AS first_seen, max(last_updated) AS last_seen FROM stats GROUP BY 1) s
       LEFT JOIN (SELECT batch_id, count(*) AS anomaly_count FROM anom GROUP BY 1) a ON s.batch_id = a.batch_id""",
)
def batch_report(spark, d):
    return aggregates.batch_report(_stats(spark, d), _anom(spark, d))


_TOP_EVENTS = """SELECT {keys}, event_rank, event_id, cnt, CAST(floor(cnt * 10 / mx) AS INTEGER) AS bar FROM (
    SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY cnt DESC, CAST(substr(event_id, 2) AS INTEGER)) AS event_rank,
    max(cnt) OVER (PARTITION BY {part}) AS mx FROM (
      SELECT {keys}, unnest(['E5', 'E7', 'E9', 'E26']) AS event_id, unnest([E5, E7, E9, E26]) AS cnt FROM {src}) WHERE cnt > 0)
    WHERE event_rank <= {n}"""


@register(
    "batch_anomalies",
    "best",
    "SELECT t.*, CASE event_id WHEN 'E5' THEN 'click' WHEN 'E26' THEN 'view' WHEN 'E9' THEN 'purchase' ELSE 'error' END AS meaning FROM ("
    + _TOP_EVENTS.format(keys="block_id, anomaly_score", part="block_id", src="best", n=5)
    + ") t",
)
def batch_anomalies(spark, d):
    return batch_jobs.batch_anomalies(_anom(spark, d), None, ad.event_meanings(spark))


@register(
    "top_events_per_block", "feats", _TOP_EVENTS.format(keys="block_id", part="block_id", src="feats", n=2)
)
def top_events_per_block(spark, d):
    return an.top_events(features.pivot_counts(_counts(spark, d), E), E, n=2)


_LISTED = f"""SELECT block_id, anomaly_score, {_cols(E)} FROM anom WHERE detected_at >= (SELECT t FROM moment) - INTERVAL 24 HOUR
    ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 10"""


@register(
    "dashboard_rows",
    "anom moment",
    f"""SELECT block_id, anomaly_score AS probability,
        CASE WHEN anomaly_score > 0.8 THEN 'high' WHEN anomaly_score > 0.5 THEN 'medium' ELSE 'low' END AS severity,
        {_pairs()} AS events, 0 AS more, 'table' AS source FROM ({_LISTED})""",
)
def dashboard_rows(spark, d):
    report = reports.dashboard(_stats(spark, d), _anom(spark, d), hours=24, as_of=_asof(spark, d))
    return report.rows.withColumn("events", _pair_text())


@register(
    "dashboard_events",
    "anom moment",
    f"""SELECT event_id, CAST(sum(n) AS BIGINT) AS total_count FROM
        (SELECT unnest({T4}) AS event_id, unnest([{_cols(T4)}]) AS n FROM ({_LISTED})) WHERE n > 0 GROUP BY 1""",
)
def dashboard_events(spark, d):
    return reports.dashboard(_stats(spark, d), _anom(spark, d), hours=24, as_of=_asof(spark, d)).distribution


@register(
    "listed_event_totals",
    "anom moment",
    f"""SELECT event_id, CAST(sum(n) AS BIGINT) AS total_count FROM
        (SELECT unnest({T4}) AS event_id, unnest([{_cols(T4)}]) AS n FROM ({_LISTED})) WHERE n > 0 GROUP BY 1""",
)
def listed_event_totals(spark, d):
    recent = an.since(_anom(spark, d), "detected_at", _asof(spark, d), 24 * 3600)
    return an.listed_event_totals(an.top_anomalies(recent, 10), E)


@register(
    "severity_tiers",
    "scored",
    """SELECT batch_id, block_id, CASE WHEN anomaly_score > 0.8 THEN 'high' WHEN anomaly_score > 0.5 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN anomaly_score >= 0.8 THEN 'high' WHEN anomaly_score >= 0.6 THEN 'medium' ELSE 'low' END AS report,
       CASE WHEN anomaly_score > 0.5 THEN 'anomaly' ELSE 'normal' END AS flag FROM scored""",
)
def severity_tiers(spark, d):
    score = F.col("anomaly_score")
    return ad.scored_blocks(_counts(spark, d)).select(
        "batch_id",
        "block_id",
        tiers.severity(score).alias("severity"),
        tiers.report_tier(score).alias("report"),
        tiers.anomaly_flag(score).alias("flag"),
    )


# ---------------------------------------------------------------- batches and boards

# The ledger of the examples: batches before the middle of the period are done.
_DONE = "SELECT DISTINCT batch_id FROM stats WHERE last_updated < TIMESTAMP '2024-01-15 00:00:00'"


def _done(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("last_updated") < F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("batch_id")


@register("distinct_batches", "stats", "SELECT DISTINCT batch_id FROM stats")
def distinct_batches(spark, d):
    return _stats(spark, d).select("batch_id").distinct()


@register("pending_batches", "stats", f"SELECT DISTINCT batch_id FROM stats WHERE batch_id NOT IN ({_DONE})")
def pending_batches(spark, d):
    stats = _stats(spark, d)
    return batches.pending_batches(stats, _done(stats))


@register(
    "offline_anomalies",
    "stats anom",
    f"SELECT batch_id, block_id, {_cols(E)}, anomaly_score, detected_at FROM anom WHERE batch_id NOT IN ({_DONE})",
)
def offline_anomalies(spark, d):
    stats = _stats(spark, d)
    todo = batches.pending_batches(stats, _done(stats))
    return batch_jobs.score_batches(stats, todo, lambda f: f.withColumn("anomaly_score", ad.score_expression()))


_MARK = "TIMESTAMP '2024-01-29 12:00:00'"


def _mark():
    return F.expr("timestamp_ntz'2024-01-29 12:00:00'")


_TOUCHED = f"SELECT block_id, {_sums(E)}, max(last_updated) AS last_updated FROM stats WHERE block_id IN (SELECT block_id FROM stats WHERE last_updated > {_MARK}) GROUP BY 1"


@register("incremental_features", "stats", _TOUCHED)
def incremental_features(spark, d):
    return batches.incremental_features(_counts(spark, d), _mark())


@register("incremental_features_large", "stats", _TOUCHED)
def incremental_features_large(spark, d):
    return batches.incremental_features(_counts(spark, d), _mark(), broadcast_blocks=0)


def _bucketed(spark, d) -> str:
    """The counts in a bucketed table, batch by batch."""
    table = f"stats_{uuid.uuid4().hex}"
    stats = _stats(spark, d)
    early = F.col("last_updated") <= F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    for part in (stats.where(early), stats.where(~early)):
        batches.store_bucketed(part, table, 8, scratch_dir(spark, "bucketed") if not spark.catalog.tableExists(table) else None)
    return table


@register("incremental_features_stored", "stats", _TOUCHED)
def incremental_features_stored(spark, d):
    return batches.incremental_features_stored(spark, _bucketed(spark, d), _mark())


@register("incremental_features_stored_large", "stats", _TOUCHED)
def incremental_features_stored_large(spark, d):
    return batches.incremental_features_stored(spark, _bucketed(spark, d), _mark(), listed=0)


@register(
    "incremental_anomalies",
    "stats",
    f"""SELECT block_id, {_cols(E)}, last_updated AS detected_at, s AS anomaly_score FROM
        (SELECT *, {_score()} AS s FROM ({_TOUCHED})) WHERE s > 0.1""",
)
def incremental_anomalies(spark, d):
    scorer = lambda f: f.withColumn("anomaly_score", ad.score_expression())
    return batch_jobs.score_incremental(_counts(spark, d), scorer, _mark(), threshold=0.1)


@register("high_water_mark", "stats", "SELECT max(last_updated) AS mark FROM stats")
def high_water_mark(spark, d):
    return batches.high_water_mark(_counts(spark, d))


@register("best_per_block", "best", f"SELECT block_id, batch_id, {_cols(T4)}, anomaly_score, detected_at FROM best")
def best_per_block(spark, d):
    return an.best_per_block(_anom(spark, d)).select("block_id", "batch_id", *T4, "anomaly_score", "detected_at")


@register("leaderboard_latest", "board", "SELECT * FROM board")
def leaderboard_latest(spark, d):
    return leaderboard.leaderboard(_anom(spark, d))


@register(
    "leaderboard_max",
    "best",
    f"""SELECT block_id, anomaly_score, {_cols(E)}, detected_at AS updated_at, detected_at + INTERVAL 3600 SECOND AS expires_at
        FROM best ORDER BY anomaly_score DESC, block_id DESC LIMIT 10""",
)
def leaderboard_max(spark, d):
    return leaderboard.leaderboard(_anom(spark, d), score_mode="max")


@register(
    "leaderboard_synced",
    "best",
    f"""SELECT block_id, anomaly_score, {_cols(E)}, detected_at AS updated_at, detected_at + INTERVAL 3600 SECOND AS expires_at
        FROM best WHERE block_id IN (SELECT block_id FROM anom WHERE detected_at > {_MARK}) ORDER BY anomaly_score DESC, block_id DESC LIMIT 10""",
)
def leaderboard_synced(spark, d):
    return batch_jobs.sync_leaderboard(_anom(spark, d), _mark())


_BEST = f"block_id, anomaly_score, {_cols(E)}, detected_at AS updated_at"


@register(
    "leaderboard_merged",
    "best anom",
    f"""SELECT * FROM (WITH stored AS (SELECT {_BEST} FROM best WHERE block_id NOT IN (SELECT block_id FROM anom WHERE detected_at > {_MARK})
          ORDER BY anomaly_score DESC, block_id DESC LIMIT 10),
        fresh AS (SELECT {_BEST} FROM best WHERE block_id IN (SELECT block_id FROM anom WHERE detected_at > {_MARK})
          ORDER BY anomaly_score DESC, block_id DESC LIMIT 10)
        SELECT *, updated_at + INTERVAL 3600 SECOND AS expires_at FROM (FROM stored UNION ALL FROM fresh)
        ORDER BY anomaly_score DESC, block_id DESC LIMIT 10)""",
)
def leaderboard_merged(spark, d):
    """New scores put onto a board that was stored before the mark and holds blocks untouched since."""
    rows = _anom(spark, d)
    later = rows.where(F.col("detected_at") > _mark()).select("block_id").distinct()
    stored = leaderboard.leaderboard(rows.join(later, "block_id", "left_anti"), score_mode="max")
    return batch_jobs.sync_leaderboard(rows, _mark(), board=stored)


@register(
    "drop_last_with_nulls",
    "",
    """SELECT event_id, part_key FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id END AS part_key,
       row_number() OVER (ORDER BY CASE WHEN event_id % 5 > 0 THEN event_id END NULLS FIRST) AS rn, count(*) OVER () AS n FROM events)
       WHERE rn <= n - n * 10 // 100""",
)
def drop_last_with_nulls(spark, d):
    keyed = F.when(F.col("event_id") % 5 > 0, F.col("event_id"))
    return ordering.drop_last_percent(_events(spark, d).select("event_id", keyed.alias("part_key")), "part_key", 10)


@register(
    "lookup_repeated_keys",
    "",
    """SELECT event_id, event_type, m AS meaning FROM events LEFT JOIN (VALUES ('click', 'a press'), ('signup', 'a new user')) AS d(k, m)
       ON event_type = k""",
)
def lookup_repeated_keys(spark, d):
    """A dimension with a repeated and a null key."""
    rows = [("click", "press twice"), ("click", "a press"), ("signup", "a new user"), (None, "nothing")]
    dimension = spark.createDataFrame(rows, "event_type string, meaning string")
    return lookup(_events(spark, d).select("event_id", "event_type"), dimension, "event_type", "meaning", "meaning")


@register(
    "leaderboard_details",
    "board moment",
    f"SELECT block_id, anomaly_score, {', '.join(f'CASE WHEN expires_at > (SELECT t FROM moment) - INTERVAL 60 HOUR THEN {e} END AS {e}' for e in T4)} FROM board",
)
def leaderboard_details(spark, d):
    as_of = F.timestamp_add("HOUR", F.lit(-60), _asof(spark, d))
    board = leaderboard.leaderboard(_anom(spark, d))
    return leaderboard.expire_details(board, as_of).select("block_id", "anomaly_score", *T4)


@register(
    "realtime_board",
    "board",
    f"SELECT block_id, anomaly_score, {_cols(E)}, updated_at AS detected_at, 'leaderboard' AS source FROM board ORDER BY anomaly_score DESC, block_id DESC LIMIT 5",
)
def realtime_board(spark, d):
    anom = _anom(spark, d)
    return reports.realtime_anomalies(_stats(spark, d), anom, leaderboard.leaderboard(anom), limit=5).rows


@register(
    "realtime_window",
    "anom moment",
    f"""SELECT block_id, anomaly_score, {_cols(E)}, detected_at, 'table' AS source FROM anom
        WHERE detected_at >= (SELECT t FROM moment) - INTERVAL 12 HOUR ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 20""",
)
def realtime_window(spark, d):
    anom = _anom(spark, d)
    board = leaderboard.leaderboard(anom)
    return reports.realtime_anomalies(_stats(spark, d), anom, board, 20, hours=12, as_of=_asof(spark, d)).rows


@register(
    "export_rows",
    "anom",
    f"SELECT block_id, anomaly_score, detected_at, {_cols(E)} FROM anom ORDER BY anomaly_score DESC, block_id, detected_at DESC LIMIT 100",
)
def export_rows(spark, d):
    return reports.export_anomalies(_anom(spark, d))


# ---------------------------------------------------------------- scoring and training


@register("anomaly_scores", "scored", "SELECT batch_id, block_id, anomaly_score FROM scored")
def anomaly_scores(spark, d):
    return ad.scored_blocks(_counts(spark, d)).select("batch_id", "block_id", "anomaly_score")


# A small net with two hidden units over the four codes, and the same as SQL.
NET = scoring.Network(
    (
        (((-0.5, 0.25), (1.5, -0.25), (-0.75, 0.5), (-0.25, 0.125)), (0.5, -1.0)),
        (((1.25,), (-0.5,)), (-0.75,)),
    )
)
_NET_SQL = """round(1 / (1 + exp(-(-0.75 + 1.25 * greatest(0, 0.5 - 0.5*E5 + 1.5*E7 - 0.75*E9 - 0.25*E26)
    - 0.5 * greatest(0, -1.0 + 0.25*E5 - 0.25*E7 + 0.5*E9 + 0.125*E26)))), 6)"""


@register("network_scores", "feats", f"SELECT block_id, {_NET_SQL} AS score FROM feats")
def network_scores(spark, d):
    wide = features.pivot_counts(_counts(spark, d), T4)
    score = scoring.network_score([F.col(e) for e in T4], NET)
    return wide.select("block_id", F.round(score, 6).alias("score"))


@register(
    "detection_summary",
    "scored",
    """SELECT count(*) AS total, count(*) FILTER (WHERE anomaly_score > 0.3) AS anomalies,
       round(count(*) FILTER (WHERE anomaly_score > 0.3) / count(*), 4) AS anomaly_ratio, CAST(0.3 AS DOUBLE) AS threshold,
       greatest(count(*) FILTER (WHERE anomaly_score > 0.3) - 10, 0) AS not_listed FROM scored""",
)
def detection_summary(spark, d):
    return model.detection_summary(ad.scored_blocks(_counts(spark, d)), 0.3)


@register(
    "detection_list",
    "scored",
    f"""SELECT row_number() OVER (ORDER BY anomaly_score DESC, block_id, batch_id) AS position, block_id, anomaly_score,
        'Fail' AS prediction, {_pairs()} AS events FROM scored WHERE anomaly_score > 0.3
        ORDER BY anomaly_score DESC, block_id, batch_id LIMIT 10""",
)
def detection_list(spark, d):
    order = [F.desc("anomaly_score"), F.col("block_id"), F.col("batch_id")]
    return model.detection_list(ad.scored_blocks(_counts(spark, d)), 0.3, order=order)


@register(
    "detected_events",
    "anom",
    "SELECT block_id, anomaly_score AS probability, event_id, CASE event_id "
    + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in ad.TEMPLATES)
    + f" END AS template, n AS count FROM (SELECT block_id, anomaly_score, unnest({T4}) AS event_id, unnest([{_cols(T4)}]) AS n FROM anom WHERE anomaly_score > 0.8) WHERE n > 0",
)
def detected_events(spark, d):
    found = training.detect_events(ad.scored_blocks(_counts(spark, d)), 0.8, dict(ad.TEMPLATES))
    return found.select("block_id", "probability", F.inline("events"))


def _by_feature(select: str) -> str:
    return " UNION ALL ".join(select.format(e=e) for e in E)


@register(
    "scaler_stats",
    "feats",
    _by_feature("SELECT '{e}' AS feature, round(avg({e}), 8) AS mean, round(stddev_pop({e}), 8) AS std FROM feats"),
)
def scaler_stats(spark, d):
    stats = scoring.scaler_stats(features.pivot_counts(_counts(spark, d), E), E)
    return stats.select("feature", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@register(
    "scaled_features",
    "feats",
    f"SELECT block_id, {', '.join(f'round((f.{e} - s.m{e}) / s.s{e}, 6) AS z_{e}' for e in T4)}, 0.0 AS z_E1 FROM feats f, "
    f"(SELECT {', '.join(f'avg({e}) AS m{e}, stddev_pop({e}) AS s{e}' for e in T4)} FROM feats) s",
)
def scaled_features(spark, d):
    wide = features.pivot_counts(_counts(spark, d), E)
    scaled = scoring.Scaler.fit(wide, E).apply(wide)
    return scaled.select("block_id", *[F.round(f"z_{e}", 6).alias(f"z_{e}") for e in [*T4, "E1"]])


@register("stratified_split", "split", "SELECT block_id, label, part FROM split")
def stratified_split(spark, d):
    return training.stratified_split(ad.labelled_training(_events(spark, d))).select("block_id", "label", "part")


@register(
    "class_weights",
    "train",
    """SELECT n0, n1, round(CAST(n0 AS DOUBLE) / n1, 6) AS pos_weight, round(1.0 / n0, 6) AS weight0, round(1.0 / n1, 6) AS weight1
       FROM (SELECT count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1 FROM train)""",
)
def class_weights(spark, d):
    out = training.class_weights(ad.labelled_training(_events(spark, d)))
    return out.select("n0", "n1", *[F.round(c, 6).alias(c) for c in ("pos_weight", "weight0", "weight1")])


_JUDGED = "SELECT target, CASE WHEN E7 * 4 > E5 + E9 + E26 + 20 THEN 1 ELSE 0 END AS p FROM train"
_CELLS = f"""SELECT count(*) FILTER (WHERE target = 0 AND p = 0) AS tn, count(*) FILTER (WHERE target = 0 AND p = 1) AS fp,
    count(*) FILTER (WHERE target = 1 AND p = 0) AS fn, count(*) FILTER (WHERE target = 1 AND p = 1) AS tp FROM ({_JUDGED})"""


def _judged(spark, d):
    rule = F.col("E7") * 4 > F.col("E5") + F.col("E9") + F.col("E26") + 20
    return ad.labelled_training(_events(spark, d)).withColumn("predicted", rule.cast("int"))


@register("confusion", "train", _CELLS)
def confusion(spark, d):
    return training.confusion(_judged(spark, d))


@register(
    "classification_report",
    "train",
    f"""SELECT target, round(CASE WHEN r + w > 0 THEN CAST(r AS DOUBLE) / (r + w) ELSE 0 END, 6) AS precision,
        round(CASE WHEN r + m > 0 THEN CAST(r AS DOUBLE) / (r + m) ELSE 0 END, 6) AS recall,
        round(CASE WHEN 2*r + m + w > 0 THEN CAST(2*r AS DOUBLE) / (2*r + m + w) ELSE 0 END, 6) AS f1,
        r + m AS support, round(acc, 6) AS accuracy FROM (
        SELECT 0 AS target, tn AS r, fp AS m, fn AS w, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS acc FROM ({_CELLS}) UNION ALL
        SELECT 1, tp, fn, fp, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) FROM ({_CELLS}))""",
)
def classification_report(spark, d):
    out = training.classification_report(_judged(spark, d))
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")}
    return out.withColumns(rounded)


@register("model_report")
def model_report(spark, d):
    return model.train_and_evaluate(ad.labelled_training(_events(spark, d))).report


@register("model_importance")
def model_importance(spark, d):
    return model.train_and_evaluate(ad.labelled_training(_events(spark, d))).importance


# ---------------------------------------------------------------- traces and windows


@register(
    "block_traces",
    "matched",
    """SELECT block_id, ts, line_no, event_id, row_number() OVER (PARTITION BY block_id ORDER BY ts, line_no) AS position
       FROM matched WHERE block_id IS NOT NULL AND event_id IS NOT NULL""",
)
def block_traces(spark, d):
    return traces.block_traces(_lines(spark, d), ad.TEMPLATES)


@register(
    "masked_templates",
    "ev",
    """SELECT template, count(*) AS lines FROM (SELECT '<*> <*> INFO store.Node: ' || CASE event_type
       WHEN 'click' THEN 'Receiving block <*> src: <*> dest: <*>' WHEN 'error' THEN 'writeBlock <*> received exception <*>'
       WHEN 'purchase' THEN 'Received block <*> of size <*> from <*>'
       WHEN 'view' THEN 'BLOCK* NameSystem.addStoredBlock: blockMap updated: <*> is added to <*> size <*>'
       ELSE CASE WHEN event_id % 2 = 0 THEN 'request timeout for <*>' ELSE 'session opened' END END AS template FROM ev) GROUP BY 1""",
)
def masked_templates(spark, d):
    return traces.masked_templates(_lines(spark, d))


_WINDOW = "SELECT date_trunc('{unit}', ts) AS window_start, " + ", ".join(
    f"count(*) FILTER (WHERE event_id = '{e}') AS {e}" for e in T4
) + " FROM matched WHERE event_id IS NOT NULL GROUP BY 1"


@register("window_counts", "matched", _WINDOW.format(unit="minute"))
def window_counts(spark, d):
    return traces.time_windows(_lines(spark, d), ad.TEMPLATES)


@register(
    "row_windows",
    "matched",
    "SELECT (rn - 1) // 100 AS window_no, count(*) AS lines, "
    + ", ".join(f"count(*) FILTER (WHERE event_id = '{e}') AS {e}" for e in T4)
    + " FROM (SELECT *, row_number() OVER (ORDER BY ts, line_no) AS rn FROM matched) GROUP BY 1",
)
def row_windows(spark, d):
    return traces.row_windows(_lines(spark, d), ad.TEMPLATES, 100)


@register(
    "window_labels",
    "matched labels_",
    f"""SELECT w.window_start, CAST(coalesce(h.label, 0) AS INTEGER) AS label FROM ({_WINDOW.format(unit='minute')}) w LEFT JOIN
        (SELECT DISTINCT date_trunc('minute', ts) AS window_start, 1 AS label FROM matched
         WHERE block_id IN (SELECT block_id FROM labels_ WHERE label = 'Anomaly')) h ON w.window_start = h.window_start""",
)
def window_labels(spark, d):
    lines = _lines(spark, d)
    windows = traces.time_windows(lines, ad.TEMPLATES)
    return jobs.label_windows(windows, lines, ad.block_labels(_events(spark, d))).select("window_start", "label")


# ---------------------------------------------------------------- streams


def _stream_lines(spark, d):
    """The log lines as a stream; event-time operators need a zoned time."""
    return ad.log_lines(ad.stream_table(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_match_types", "classed", "SELECT match_type, type, count(*) AS lines FROM classed GROUP BY 1, 2")
def stream_match_types(spark, d):
    base = scratch_dir(spark, "classified")
    jobs.classify_stream(_stream_lines(spark, d), ad.TEMPLATES, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("match_type", "type").agg(F.count("*").alias("lines"))


@register("stream_block_counts", "stats", f"SELECT block_id, {_sums(T4)}, max(last_updated) AS last_updated FROM stats GROUP BY 1")
def stream_block_counts(spark, d):
    base = scratch_dir(spark, "counts")
    events = jobs.matched_events(_stream_lines(spark, d), ad.TEMPLATES)
    counts = jobs.running_counts(events, T4)
    jobs.write_updates(counts, f"{base}/out", f"{base}/cp").awaitTermination()
    latest = jobs.latest_counts(spark, f"{base}/out", T4)
    return latest.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@register("stream_block_counts_daily", "stats", f"SELECT block_id, {_sums(T4)} FROM stats GROUP BY 1")
def stream_block_counts_daily(spark, d):
    base = scratch_dir(spark, "daily")
    events = jobs.matched_events(_stream_lines(spark, d), ad.TEMPLATES)
    counts = jobs.running_counts(events, T4, bucket="1 day", late="60 days")
    jobs.write_updates(counts, f"{base}/out", f"{base}/cp").awaitTermination()
    return jobs.latest_counts(spark, f"{base}/out", T4).drop("last_updated")


#: Files that a stream over ``_pieces`` takes at a time.
FILES = 4


def _pieces(spark, events: DataFrame, key: str = "event_id", pieces: int = 4) -> str:
    """The rows as files of a folder, dealt by the hash of ``key``: a stream that takes ``FILES`` at a time meets them out of order."""
    path = scratch_dir(spark, "pieces")
    events.repartition(pieces * FILES, key).write.parquet(path)
    return path


def _stream_pieces(spark, d, more: DataFrame | None = None) -> DataFrame:
    """The log lines in four out-of-order micro-batches, and those of ``more`` in a last one."""
    events = _events(spark, d)
    path = _pieces(spark, events)
    if more is not None:
        more.coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    return ad.log_lines(raw).withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_state_counts", "stats", f"SELECT block_id, {_sums(T4)}, max(last_updated) AS last_updated FROM stats GROUP BY 1")
def stream_state_counts(spark, d):
    checkpoint = scratch_dir(spark, "state")
    counts = jobs.running_counts(jobs.matched_events(_stream_pieces(spark, d), ad.TEMPLATES), T4)
    jobs.keep_counts(counts, checkpoint).awaitTermination()
    return jobs.state_counts(spark, checkpoint, counts, T4).withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


@register("stream_state_counts_daily", "stats", f"SELECT block_id, {_sums(T4)}, max(last_updated) AS last_updated FROM stats GROUP BY 1")
def stream_state_counts_daily(spark, d):
    checkpoint = scratch_dir(spark, "state")
    counts = jobs.running_counts(jobs.matched_events(_stream_pieces(spark, d), ad.TEMPLATES), T4, bucket="1 day")
    jobs.keep_counts(counts, checkpoint).awaitTermination()
    return jobs.state_counts(spark, checkpoint, counts, T4).withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


def _later(spark, d, days: int) -> DataFrame:
    """One event that many days after the newest: the time goes on without any row of a block."""
    events = _events(spark, d)
    newest = events.agg(F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("e")).select("e.*")
    return newest.withColumns({"ts": F.expr(f"ts + INTERVAL {days} DAY"), "event_id": F.col("event_id") + 1, "event_type": F.lit("signup")})


@register(
    "stream_row_windows",
    "matched",
    "SELECT (rn - 1) // 100 AS window_no, count(*) AS lines, "
    + ", ".join(f"count(*) FILTER (WHERE event_id = '{e}') AS {e}" for e in T4)
    + " FROM (SELECT *, row_number() OVER (ORDER BY ts, line_no) AS rn FROM matched) GROUP BY 1",
)
def stream_row_windows(spark, d):
    base = scratch_dir(spark, "rows")
    lines = _stream_pieces(spark, d, _later(spark, d, 800))
    row_windows_.write_row_windows(
        lines, ad.TEMPLATES, 100, f"{base}/out", f"{base}/cp", late="400 days", slot_seconds=86_400
    ).awaitTermination()
    return row_windows_.read_row_windows(spark, f"{base}/out").select("window_no", "lines", *T4)


@register(
    "stream_expired_details",
    "board moment",
    f"SELECT block_id, anomaly_score, {', '.join(f'CASE WHEN expires_at > (SELECT t FROM moment) - INTERVAL 60 HOUR THEN {e} END AS {e}' for e in T4)} FROM board",
)
def stream_expired_details(spark, d):
    """``leaderboard_details`` by a stream: details leave the state 60 hours and a detail's time after their row."""
    anomalies, base = _anom(spark, d), scratch_dir(spark, "details")
    rows = anomalies.withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    pieces = _pieces(spark, rows, "block_id", 3)
    # A row of a block that scores lowest tells the time, as much later as rows may be late.
    now = _events(spark, d).agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 60 DAY")).alias("detected_at"))
    clock = now.select(F.lit("clock").alias("block_id"), F.lit(-1.0).alias("anomaly_score"), "detected_at")
    clock = rows.where("false").unionByName(clock, allowMissingColumns=True)
    clock.coalesce(1).write.mode("append").parquet(pieces)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(pieces)
    details.keep_board(stream, f"{base}/board", f"{base}/cp", seconds=3600 + 60 * 3600, late="60 days", event_ids=E).awaitTermination()
    return boards.read_board(spark, f"{base}/board").select("block_id", "anomaly_score", *T4)


_STREAM_SCORE = f"SELECT block_id, {_sums(E)}, max(last_updated) AS detected_at FROM stats GROUP BY 1"


def _run_scores(spark, d) -> str:
    base = scratch_dir(spark, "scores")
    counts = jobs.running_counts(jobs.matched_events(_stream_lines(spark, d), ad.TEMPLATES), E)
    scorer = lambda f: f.withColumn("anomaly_score", ad.score_expression())
    query = jobs.score_stream(counts, scorer, f"{base}/anomalies", f"{base}/board", f"{base}/cp", threshold=0.1)
    query.awaitTermination()
    return base


@register(
    "stream_anomalies",
    "stats",
    f"SELECT block_id, {_cols(E)}, anomaly_score, detected_at FROM (SELECT *, {_score()} AS anomaly_score FROM ({_STREAM_SCORE})) WHERE anomaly_score > 0.1",
)
def stream_anomalies(spark, d):
    rows = spark.read.parquet(f"{_run_scores(spark, d)}/anomalies").drop("micro_batch")
    return rows.withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz"))


@register(
    "stream_leaderboard",
    "stats",
    f"""SELECT block_id, anomaly_score, {_cols(E)} FROM (SELECT *, {_score()} AS anomaly_score FROM ({_STREAM_SCORE}))
        WHERE anomaly_score > 0.1 ORDER BY anomaly_score DESC, block_id DESC LIMIT 10""",
)
def stream_leaderboard(spark, d):
    board = boards.read_board(spark, f"{_run_scores(spark, d)}/board")
    return board.select("block_id", "anomaly_score", *E)


@register("stream_window_counts", "matched", _WINDOW.format(unit="hour"))
def stream_window_counts(spark, d):
    base = scratch_dir(spark, "windows")
    counts = jobs.window_counts(_stream_lines(spark, d), ad.TEMPLATES, length="1 hour")
    jobs.write_updates(counts, f"{base}/out", f"{base}/cp").awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    final = rows.groupBy("window_start").agg(*[F.max(e).alias(e) for e in T4])
    return final.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- knowledge


@register(
    "doc_load_once",
    "",
    """SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents
       WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') GROUP BY 2""",
)
def doc_load_once(spark, d):
    docs = ad.table(spark, d, "documents")
    seen = docs.where("source = 'src0'").select(F.md5("text").alias("md5"))
    return retrieval.load_once(docs, seen).select("doc_id", "md5")


def _chunk_sql() -> str:
    """Level by level cuts, then a walk from chunk to chunk over the lengths of the pieces."""
    parts = ["s0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text AS t, -1 AS level, true AS opens, false AS whole, false AS done FROM documents)"]
    last = len(chunking.SEPARATORS) - 1
    for i, sign in enumerate(chunking.SEPARATORS):
        sign = sign.replace("\n", "' || chr(10) || '")
        parts.append(f"""s{i + 1} AS (SELECT * FROM s{i} WHERE done UNION ALL
            SELECT doc_id, list_append(path, i), p, {i}, i = 1, length(p) >= 200, {'true' if i == last else 'length(p) < 200'} FROM
            (SELECT doc_id, path, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, path, list_filter(list_transform(
            string_split(t, '{sign}'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '{sign}' || x END), lambda x: x <> '') AS ps FROM s{i} WHERE NOT done)))""")
    chars = chunking.SPACE.replace("\\u1680", "\\x{1680}").replace("\\u2000-\\u200a", "\\x{2000}-\\x{200a}")
    for code in ("2028", "2029", "202f", "205f", "3000"):
        chars = chars.replace(f"\\u{code}", f"\\x{{{code}}}")
    parts += [
        f"""r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY path) AS run FROM (SELECT *, CASE WHEN whole OR opens
            OR level <> lag(level) OVER w OR lag(whole) OVER w THEN 1 ELSE 0 END AS fresh FROM s{last + 1} WINDOW w AS (PARTITION BY doc_id ORDER BY path)))""",
        """pc AS (SELECT doc_id, run, t, whole, row_number() OVER w AS n, CAST(sum(length(t)) OVER w AS BIGINT) AS upto
            FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY path))""",
        """ends AS (SELECT a.doc_id, a.run, a.n, max(b.n) AS b FROM pc a JOIN pc b ON a.doc_id = b.doc_id AND a.run = b.run AND b.n >= a.n
            AND (b.n = a.n OR b.upto - a.upto + length(a.t) <= 200) GROUP BY ALL)""",
        """nexts AS (SELECT x.doc_id, x.run, x.n AS b, min(CASE WHEN y.n <= x.n AND x.upto - y.upto + length(y.t) <= least(20, 200 - length(z.t))
            THEN y.n ELSE x.n + 1 END) AS a FROM pc x JOIN pc z ON x.doc_id = z.doc_id AND x.run = z.run AND z.n = x.n + 1
            JOIN pc y ON x.doc_id = y.doc_id AND x.run = y.run AND y.n <= x.n AND y.n > x.n - 20 GROUP BY ALL)""",
        """walk AS (SELECT doc_id, run, CAST(1 AS BIGINT) AS a FROM pc GROUP BY ALL UNION ALL SELECT w.doc_id, w.run, x.a FROM walk w
            JOIN ends e ON w.doc_id = e.doc_id AND w.run = e.run AND w.a = e.n JOIN nexts x ON w.doc_id = x.doc_id AND w.run = x.run AND x.b = e.b)""",
        f"""cut AS (SELECT w.doc_id, w.run, w.a, CASE WHEN bool_or(whole) THEN string_agg(t, '' ORDER BY p.n)
            ELSE regexp_replace(string_agg(t, '' ORDER BY p.n), '^[{chars}]+|[{chars}]+$', '', 'g') END AS chunk FROM walk w
            JOIN ends e ON w.doc_id = e.doc_id AND w.run = e.run AND w.a = e.n
            JOIN pc p ON w.doc_id = p.doc_id AND w.run = p.run AND p.n BETWEEN w.a AND e.b GROUP BY ALL)""",
    ]
    return f"""WITH RECURSIVE {', '.join(parts)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, a) - 1 AS INTEGER)
        AS chunk_no, chunk FROM cut WHERE chunk <> ''"""


@register("doc_chunks", "", _chunk_sql())
def doc_chunks(spark, d):
    return chunking.chunk_documents(ad.table(spark, d, "documents"))


@register(
    "knowledge_chunks",
    "",
    f"""SELECT c.doc_id, c.chunk_no, c.chunk, o.md5 FROM ({_chunk_sql()}) c JOIN (SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents
       WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') GROUP BY 2) o ON c.doc_id = o.doc_id""",
)
def knowledge_chunks(spark, d):
    """The chunks of documents whose content is new."""
    docs = ad.table(spark, d, "documents")
    seen = docs.where("source = 'src0'").select(F.md5("text").alias("md5"))
    return knowledge.load_knowledge(docs, seen).select("doc_id", "chunk_no", "chunk", "md5")


@register("topk_similar", "ranked", "SELECT query_id, rank, item_id, round(s, 6) AS score FROM ranked")
def topk_similar(spark, d):
    vectors = ad.table(spark, d, "embeddings")
    found = retrieval.topk_similar(ad.label_queries(vectors), ad.vectors(vectors))
    return found.withColumn("score", F.round("score", 6))


@register("topk_similar_blocks", "ranked", "SELECT query_id, rank, item_id, round(s, 6) AS score FROM ranked")
def topk_similar_blocks(spark, d):
    vectors = ad.table(spark, d, "embeddings")
    found = retrieval.topk_similar(ad.label_queries(vectors), ad.vectors(vectors), max_inline=4, cell_rows=100)
    return found.withColumn("score", F.round("score", 6))


_KEYWORDS = " UNION ALL ".join(f"SELECT '{e}' AS query_id, '{t}' AS text" for e, t in ad.TEMPLATES)
_WORD_HITS = f"""SELECT DISTINCT q.query_id, doc.doc_id AS item_id FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS w FROM ({_KEYWORDS})) q
    JOIN documents doc ON contains(lower(doc.text), q.w)"""


@register("keyword_search", "", _WORD_HITS)
def keyword_search(spark, d):
    return keyword_index.keyword_search(ad.template_questions(spark), ad.table(spark, d, "documents"))


@register("keyword_search_blocks", "", _WORD_HITS)
def keyword_search_blocks(spark, d):
    """By a stored index, with frequent runs dealt into many parts."""
    docs, path = ad.table(spark, d, "documents"), scratch_dir(spark, "postings")
    keyword_index.gram_postings(docs).write.parquet(path)
    return keyword_index.keyword_search(ad.template_questions(spark), docs, postings=spark.read.parquet(path), part_rows=100)


# Every benchmark passage is a question; short words of one and two characters are among its words.
@register(
    "keyword_search_passages",
    "",
    """SELECT q.query_id, doc.doc_id AS item_id FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS w
       FROM benchmark) q JOIN documents doc ON contains(lower(doc.text), q.w) WHERE length(w) > 9 GROUP BY 1, 2""",
)
def keyword_search_passages(spark, d):
    words = F.filter(tx.keywords(F.col("text")), lambda w: F.length(w) > 9)
    asked = ad.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))
    return keyword_index.keyword_search(asked, ad.table(spark, d, "documents"))


def _diverse_sql(k: int, fetch: int) -> str:
    """One step after the other: the best of what is left, by score less likeness to what is chosen."""
    cos = "list_cosine_similarity(CAST({}.v AS DOUBLE[]), CAST({}.v AS DOUBLE[]))"
    parts = [f"""c AS (SELECT query_id, item_id, s, embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS pos
        FROM (SELECT query_id, vec_id AS item_id, embedding, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS s FROM queries_, embeddings)) WHERE pos <= {fetch})""",
        "d1 AS (SELECT query_id, 1 AS rank, item_id, s, v FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) = 1)"]
    for i in range(2, k + 1):
        parts.append(f"""d{i} AS (SELECT * FROM d{i - 1} UNION ALL SELECT query_id, {i}, item_id, s, v FROM (
            SELECT c.query_id, c.item_id, any_value(c.s) AS s, any_value(c.v) AS v, 0.5 * any_value(c.s) - 0.5 * max({cos.format('c', 'd')}) AS m FROM c JOIN d{i - 1} d
            ON c.query_id = d.query_id GROUP BY 1, 2 HAVING count(*) FILTER (WHERE c.item_id = d.item_id) = 0)
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m DESC, item_id) = 1)""")
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT query_id, rank, item_id, round(s, 6) AS score FROM d{k})"


@register("diverse_answers", "queries_", _diverse_sql(5, 20))
def diverse_answers(spark, d):
    vectors = ad.table(spark, d, "embeddings")
    found = retrieval.similar_and_diverse(ad.label_queries(vectors), ad.vectors(vectors), k=5)
    return found.withColumn("score", F.round("score", 6))


@register(
    "question_words",
    "",
    "SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9_]+'), ' ') AS words FROM conversations",
)
def question_words(spark, d):
    words = F.array_join(tx.keywords(F.col("text")), " ")
    return ad.table(spark, d, "conversations").select("conv_id", "turn", words.alias("words"))


_FOUND = """SELECT query_id, 'vector' AS source, rank, item_id, round(s, 6) AS score FROM ranked WHERE s >= 0.9
    UNION ALL SELECT q.query_id, 'keyword', NULL, doc.doc_id, NULL FROM (SELECT query_id FROM queries_ WHERE query_id NOT IN
    (SELECT query_id FROM ranked WHERE s >= 0.9)) q JOIN documents doc
    ON contains(lower(doc.text), 'topic') OR contains(doc.text, CAST(q.query_id AS VARCHAR))"""


@register("retrieve_fallback", "ranked", _FOUND)
def retrieve_fallback(spark, d):
    vectors = ad.table(spark, d, "embeddings")
    found = knowledge.retrieve(
        ad.label_queries(vectors), ad.vectors(vectors), ad.table(spark, d, "documents"), min_score=0.9
    )
    return found.withColumn("score", F.round("score", 6))


@register(
    "context_text",
    "ranked",
    """SELECT query_id, string_agg('[参考资料' || rank || ']:参考资料:' || text || ' | 参考源数据：' || source || chr(10), '' ORDER BY rank) AS context
       FROM ranked JOIN documents ON item_id = doc_id GROUP BY 1""",
)
def context_text(spark, d):
    vectors = ad.table(spark, d, "embeddings")
    found = retrieval.topk_similar(ad.label_queries(vectors), ad.vectors(vectors))
    return knowledge.contexts(found, ad.table(spark, d, "documents"))


@register("error_sections", "codes", "SELECT doc_id, code AS event_id, event_type || ' ' || n AS title, level AS severity FROM codes")
def error_sections(spark, d):
    return know.error_sections(ad.knowledge_text(_events(spark, d)))


@register("error_table", "codes", "SELECT doc_id, code AS event_id, event_type AS type, level AS severity, 'check ' || n AS action FROM codes")
def error_table(spark, d):
    return know.error_table(ad.knowledge_text(_events(spark, d)))


# ---------------------------------------------------------------- chat


@register(
    "command_tags",
    "msgs",
    """SELECT conv_id, turn, CASE WHEN text LIKE '%健康度%' THEN 'get_system_health'
         WHEN text LIKE '%过去2小时%' OR text LIKE '%过去30分钟%' OR text LIKE '%过去1小时%' THEN 'get_recent_anomalies'
         WHEN text LIKE '%top10%' THEN 'get_top_anomalies' WHEN text LIKE '%导出%' THEN 'export_anomalies'
         WHEN regexp_matches(text, '过去[0-9]+(小时|分钟|秒|天)') THEN 'get_recent_anomalies'
         WHEN regexp_matches(text, '(top|前)[0-9]+') THEN 'get_top_anomalies' ELSE 'show_help' END AS tool,
       CASE WHEN text LIKE '%健康度%' THEN '' WHEN text LIKE '%过去2小时%' THEN 'hours=2' WHEN text LIKE '%过去30分钟%' THEN 'minutes=30'
         WHEN text LIKE '%过去1小时%' THEN 'hours=1' WHEN text LIKE '%top10%' THEN 'limit=10' WHEN text LIKE '%导出%' THEN ''
         WHEN regexp_matches(text, '过去[0-9]+(小时|分钟|秒|天)') THEN CASE regexp_extract(text, '过去([0-9]+)(小时|分钟|秒|天)', 2)
           WHEN '小时' THEN 'hours=' WHEN '分钟' THEN 'minutes=' WHEN '秒' THEN 'seconds=' ELSE 'days=' END || regexp_extract(text, '过去([0-9]+)', 1)
         WHEN regexp_matches(text, '(top|前)[0-9]+') THEN 'limit=' || regexp_extract(text, '(top|前)([0-9]+)', 2) ELSE '' END AS params FROM msgs""",
)
def command_tags(spark, d):
    found = intents.command(F.col("text"))
    return ad.operator_messages(_events(spark, d)).select("conv_id", "turn", found.alias("c")).select("conv_id", "turn", "c.*")


_ROUTE = """CASE WHEN regexp_matches({t}, '(?i)intent: *data') THEN 'data' WHEN regexp_matches({t}, '(?i)intent: *monitor') THEN 'monitor'
    WHEN {t} LIKE '%异常%' THEN 'diagnosis' WHEN {t} LIKE '%数据%' OR {t} LIKE '%训练%' OR {t} LIKE '%模型%' THEN 'data' WHEN {t} LIKE '%启动服务%' THEN 'monitor'
    WHEN {t} LIKE '%配置%' OR {t} LIKE '%清理%' OR {t} LIKE '%重启服务%' THEN 'ops' ELSE 'general' END"""
_CONF = """CASE WHEN regexp_matches({t}, '(?i)intent: *(data|monitor)')
    THEN CASE WHEN {t} LIKE '%CONFIDENCE: %' THEN CAST(regexp_extract({t}, 'CONFIDENCE: *([0-9.]+)', 1) AS DOUBLE) ELSE 0.7 END
    WHEN {r} = 'general' THEN 0.5 ELSE 0.6 END"""


@register(
    "route_tags",
    "msgs",
    f"SELECT conv_id, turn, intent, CAST({_CONF.format(t='text', r='intent')} AS DOUBLE) AS confidence FROM (SELECT *, {_ROUTE.format(t='text')} AS intent FROM msgs)",
)
def route_tags(spark, d):
    found = intents.route(F.col("text"))
    return ad.operator_messages(_events(spark, d)).select("conv_id", "turn", found.alias("r")).select("conv_id", "turn", "r.*")


_LAST = "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM {src} WHERE role = 'user' GROUP BY 1"


@register("last_user_message", "", _LAST.format(src="conversations"))
def last_user_message(spark, d):
    return chat.last_user_message(ad.table(spark, d, "conversations"))


_ERROR_TYPE = """CASE WHEN text LIKE '%训练失败%' THEN 'model_not_ready' WHEN lower(text) LIKE '%connection refused%' THEN 'connection_failed' END"""
_RECENT_ERROR = f"""SELECT conv_id, coalesce(max_by(e, turn) FILTER (WHERE e IS NOT NULL), '') AS error_type FROM (
    SELECT *, {_ERROR_TYPE} AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM msgs) WHERE rn <= 10 GROUP BY 1"""


@register("recent_errors", "msgs", _RECENT_ERROR)
def recent_errors(spark, d):
    return chat.recent_error(ad.operator_messages(_events(spark, d)))


_PENDING = """SELECT conv_id, CASE max_by(text, turn) WHEN '请确认清理 Redis' THEN 'cleanup_data' ELSE 'check_service' END AS pending
    FROM msgs WHERE role = 'assistant' AND text LIKE '%确认%' GROUP BY 1"""


@register("pending_operations", "msgs", _PENDING)
def pending_operations(spark, d):
    return chat.pending_operations(ad.operator_messages(_events(spark, d)))


@register(
    "urgency_tags",
    "msgs",
    """SELECT conv_id, turn, CASE WHEN text LIKE '%紧急%' THEN 'urgent' WHEN text LIKE '%！！%' THEN 'anxious' ELSE 'normal' END AS urgency FROM msgs""",
)
def urgency_tags(spark, d):
    return ad.operator_messages(_events(spark, d)).select("conv_id", "turn", intents.urgency(F.col("text")).alias("urgency"))


@register(
    "conversation_tags",
    "msgs",
    f"""SELECT conv_id, turn AS last_turn, conf AS is_confirmation, pending,
        CASE WHEN conf AND pending <> '' THEN 'ops' WHEN conf THEN 'general' ELSE r END AS intent,
        CAST(CASE WHEN conf AND pending <> '' THEN 1.0 WHEN conf THEN 0.8 ELSE {_CONF.format(t='text', r='r')} END AS DOUBLE) AS confidence, error_type FROM (
        SELECT l.*, trim(text) IN ('确认', 'yes') AS conf, coalesce(p.pending, '') AS pending, {_ROUTE.format(t='text')} AS r, e.error_type
        FROM ({_LAST.format(src='msgs')}) l LEFT JOIN ({_PENDING}) p ON l.conv_id = p.conv_id JOIN ({_RECENT_ERROR}) e ON l.conv_id = e.conv_id)""",
)
def conversation_tags(spark, d):
    tags = conversations.tag_conversations(ad.operator_messages(_events(spark, d)))
    return tags.select("conv_id", "last_turn", "is_confirmation", "pending", "intent", "confidence", "error_type")


@register(
    "chat_tags",
    "",
    f"""SELECT c.conv_id, turn AS last_turn, false AS is_confirmation, '' AS pending, 'show_help' AS tool, '' AS params,
        'unknown' AS operation, CASE WHEN regexp_matches(coalesce(text, ''), '\\?{{2,}}|(?i)tmd|(?i)fuck') OR len(text) - len(replace(text, '?', '')) >= 3
        THEN 'anxious' ELSE 'normal' END AS urgency, '' AS error_type
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ({_LAST.format(src='conversations')}) l ON c.conv_id = l.conv_id""",
)
def chat_tags(spark, d):
    tags = conversations.tag_conversations(ad.table(spark, d, "conversations"))
    return tags.drop("intent", "confidence")


@register(
    "duration_seconds",
    "",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN n = 0 THEN 3600 ELSE n END
         WHEN 'view' THEN CASE WHEN n = 0 THEN 3600 ELSE n * 60 END WHEN 'purchase' THEN n * 3660 + 15
         WHEN 'error' THEN greatest(n, 1) * 3600
         ELSE CASE WHEN event_id % 2 = 0 AND n > 0 THEN n * 86400 ELSE 3600 END END AS seconds
       FROM (SELECT *, CAST(floor(value) AS BIGINT) AS n FROM events)""",
)
def duration_seconds(spark, d):
    texts = ad.duration_texts(_events(spark, d))
    return texts.select("event_id", tx.duration_seconds(F.col("text")).alias("seconds"))
