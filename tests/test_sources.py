import os

import pytest

from logloom.schemas import event_order
from logloom.sources import knowledge as kn
from logloom.sources import logs, sinks, tables
from logloom.sources.numbering import numbered

IDS = ["E1", "E2"]


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_event_order():
    assert event_order(["E10", "E2", "E1"]) == ["E1", "E2", "E10"]


def test_templates_keep_file_order_and_quotes(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'EventId,EventTemplate\nE2,"a, ""b"" [*]"\nE1,c\n')
    assert logs.load_templates(spark, path) == [("E2", 'a, "b" [*]'), ("E1", "c")]
    table = logs.load_templates(spark, path, limit=1)
    assert [tuple(r) for r in table.orderBy("position").collect()] == [(0, "E2", 'a, "b" [*]'), (1, "E1", "c")]


def test_log_lines(spark, tmp_path):
    path = write(tmp_path / "x.log", " a \n\n\t\nb\r\n")
    assert sorted(r.line for r in logs.read_log_lines(spark, path).collect()) == ["a", "b"]


def test_matrix_accepts_either_block_name_any_order_and_a_mark(spark, tmp_path, values):
    one = write(tmp_path / "a.csv", "BlockId,Label,Type,E2,E1\nb,Fail,7,2,1\na,Success,,x,3.0\n", "utf-8-sig")
    df = tables.read_matrix(spark, one, IDS)
    assert values(df, "block_id", "E1", "E2") == [("a", 3, None), ("b", 1, 2)]
    assert [r.block_id for r in tables.read_matrix(spark, one, IDS, first=1).collect()] == ["a"]
    assert values(tables.project_labels(df)) == [("a", "Success"), ("b", "Fail")]
    with pytest.raises(ValueError):
        tables.read_matrix(spark, one, ["E1", "E3"])


def test_missing_labels_mean_none(spark, tmp_path):
    assert tables.read_labels(spark, str(tmp_path / "none.csv")).count() == 0
    bad = write(tmp_path / "bad.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_labels(spark, bad)


def test_upload(spark, tmp_path, values):
    path = write(tmp_path / "u.csv", "block_id,E2,other\nblk_1,4,z\nblk_2,0,z\n")
    assert values(tables.read_upload(spark, path, "77", IDS)) == [("77", "blk_1", "E2", 4)]


def test_first_valid_source(spark, tmp_path):
    empty = write(tmp_path / "m.csv", "BlockId,Label,E1,E2\n")
    matrix = write(tmp_path / "m2.csv", "BlockId,Label,E1,E2\na,Fail,1,2\n")
    training = write(tmp_path / "t.csv", "BlockId,target\na,1\n")
    features = write(tmp_path / "f.csv", "BlockId,E1,E2\na,1,2\n")
    labels = write(tmp_path / "l.csv", "BlockId,Label\na,Fail\n")
    gone = str(tmp_path / "gone.csv")
    pick = lambda **kw: tables.first_valid_source(spark, event_ids=IDS, **kw)[0]
    assert pick(matrix=matrix, training=training) == "matrix"
    assert pick(matrix=empty, training=training) == "training"
    assert pick(matrix=gone, features=features, labels=labels) == "features"
    assert pick(matrix=gone, features=features, from_logs=lambda: spark.range(1)) == "logs"
    with pytest.raises(FileNotFoundError):
        pick(matrix=gone)
    _, df = tables.first_valid_source(spark, features=features, labels=labels, event_ids=IDS)
    assert tuple(df.first()) == ("a", "Fail", 1, 1, 2)


def test_kafka_options():
    got = logs.kafka_options("h:1", "t", max_per_trigger=5, group="g")
    assert got == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5", "kafka.group.id": "g"}
    sink = sinks.kafka_sink_options("h:1", "t", acks="0")
    assert (sink["topic"], sink["kafka.acks"], sink["kafka.compression.type"]) == ("t", "0", "gzip")


def test_matrix_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "block_id string, E1 long")
    sinks.write_matrix(df, str(tmp_path / "csv"), "csv")
    text = "".join(open(tmp_path / "csv" / n).read() for n in sorted(os.listdir(tmp_path / "csv")) if n.endswith(".csv"))
    assert text.replace("block_id,E1\n", "") == "a,2\nb,1\n"
    sinks.write_matrix(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_export_starts_with_a_byte_order_mark(spark, tmp_path):
    sinks.write_export(spark.createDataFrame([("a", 1)], "block_id string, E1 long"), str(tmp_path / "x"))
    (name,) = [n for n in os.listdir(tmp_path / "x") if n.endswith(".csv")]
    raw = open(tmp_path / "x" / name, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfblock_id,E1\n") and raw.endswith(b"a,1\n")


def test_split_into_files(spark, tmp_path):
    df = spark.range(0, 1000, 1, 1).selectExpr("cast(id as string) as value")
    sinks.split_lines(df, str(tmp_path / "s"), 300)
    names = sorted(n for n in os.listdir(tmp_path / "s") if n.endswith(".txt"))
    lines = [open(tmp_path / "s" / n).read().split() for n in names]
    assert [len(x) for x in lines] == [300, 300, 300, 100]
    assert [int(v) for x in lines for v in x] == list(range(1000))


def test_files_of_exactly_n_lines_over_several_files_and_splits(spark, tmp_path):
    numbers = iter(range(1000))
    os.makedirs(tmp_path / "in")
    for name, n in (("a.log", 333), ("b.log", 0), ("c.log", 1), ("d.log", 666)):
        write(tmp_path / "in" / name, "".join(f"line {next(numbers):04d}\n" for _ in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        sinks.split_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), 70)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folders = sorted((n for n in os.listdir(tmp_path / "out") if "=" in n), key=lambda n: int(n.split("=")[1]))
    assert len(folders) == 15
    seen = []
    for folder in folders:
        (name,) = [n for n in os.listdir(tmp_path / "out" / folder) if n.endswith(".txt")]
        seen.append(open(tmp_path / "out" / folder / name).read().splitlines())
    assert [len(x) for x in seen] == [70] * 14 + [20]
    assert [int(v.split()[1]) for x in seen for v in x] == list(range(1000))


def test_many_small_files_are_numbered_in_one_reading(spark, tmp_path, values):
    os.makedirs(tmp_path / "in")
    for i in range(40):
        write(tmp_path / "in" / f"{i:02d}.log", "".join(f"{i} {j}\n" for j in range(i % 4)))
    source = spark.read.text(str(tmp_path / "in"))
    want = values(numbered(source, "n"), "value", "n")
    got = numbered(source, "n", once=True)
    assert len(want) == 60 and values(got, "value", "n") == want
    assert 0 < len(got.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert not [name for name in got.inputFiles() if name.endswith(".log")]


def test_unmatched_lines_are_kept(spark, tmp_path):
    df = spark.createDataFrame([("a", "template"), ("b", "unknown")], "line string, match_type string")
    for _ in range(2):
        sinks.write_unmatched(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_knowledge_files_and_codes(spark, tmp_path):
    text = "# t\n### E1: blk_* not found\n**严重程度**: 高\n\nx\n### E30: no level\n\n## 速查\n| 事件ID | 类型 |\n|---|---|\n| E1 | Block不存在 | 高 | 检查 + 删除 |\n| E26 | 连接拒绝 | 中 | 检查服务 |"
    write(tmp_path / "codes.txt", text)
    write(tmp_path / "skip.md", "### E9: x\n**严重程度**: 低\n")
    docs = kn.read_knowledge(spark, str(tmp_path))
    assert docs.count() == 1
    assert [tuple(r)[1:] for r in kn.error_sections(docs).collect()] == [("E1", "blk_* not found", "高")]
    assert [tuple(r)[1:] for r in kn.error_table(docs).collect()] == [("E1", "Block不存在", "高", "检查 + 删除"), ("E26", "连接拒绝", "中", "检查服务")]


def test_rescored_batch_loses_what_it_had(spark, values, tmp_path):
    path = str(tmp_path / "anomalies")
    rows = [("b1", "x", 0.9), ("b2", "y", 0.8), ("b 3", "z", 0.7)]
    frame = lambda r: spark.createDataFrame(r, "batch_id string, block_id string, anomaly_score double")
    both = spark.createDataFrame([("b1",), ("b 3",), ("b4",)], "batch_id string")
    sinks.append_anomalies(frame(rows), path, both)
    sinks.append_anomalies(frame([("b1", "w", 0.6)]), path, both)
    assert values(spark.read.parquet(path), "batch_id", "block_id") == [("b1", "w"), ("b2", "y")]
