import json
import threading

import pytest

from factloom.sources import files, log

ROW = "id string, text string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def held(spark, path):
    return {r["id"]: r["text"] for r in files.scan_corpus(spark, path).collect()}


def test_the_later_of_two_appends_holds_every_time(spark, tmp_path):
    for k in range(20):
        path = str(tmp_path / f"log{k}")
        assert log.append(rows(spark, ("x", "old"), ("y", "only")), path) == 1
        assert log.append(rows(spark, ("x", "new")), path) == 2
        assert held(spark, path) == {"x": "new", "y": "only"}


def test_lines_of_one_large_file_keep_their_order(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text("".join(json.dumps({"id": f"c-{i % 100}", "text": str(i)}) + "\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert files.read_lines(spark, str(path), files.CORPUS).rdd.getNumPartitions() > 3
        assert held(spark, str(path)) == {f"c-{i}": str(19_900 + i) for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_appends_at_once_all_get_a_number(spark, tmp_path):
    path, got = str(tmp_path / "log"), []

    def one(k):
        got.append(log.append(rows(spark, ("x", str(k)), (f"y{k}", "")), path))

    threads = [threading.Thread(target=one, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and len(held(spark, path)) == 7


def test_what_was_not_committed_is_not_there(spark, tmp_path):
    path = str(tmp_path / "log")
    rows(spark, ("x", "lost")).write.json(f"{path}/append={'0' * 32}")
    assert held(spark, path) == {}
    log.append(rows(spark, ("x", "kept")), path)
    assert held(spark, path) == {"x": "kept"}


def test_a_token_appends_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert [log.append(rows(spark, ("x", str(k))), path, token="t") for k in range(3)] == [1, 1, 1]
    assert held(spark, path) == {"x": "0"}


def test_compaction_keeps_order_and_what_comes_after(spark, tmp_path):
    path = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "first.jsonl").write_text('{"id":"a","text":"0"}\n{"id":"b","text":"0"}\nbroken\n')
    for k in (1, 2):
        log.append(rows(spark, ("a", str(k))), path)
    log.compact(spark, path, files.CORPUS)
    assert held(spark, path) == {"a": "2", "b": "0"}
    log.append(rows(spark, ("b", "3")), path)
    assert log.clean(spark, path) == 2 and held(spark, path) == {"a": "2", "b": "3"}
    log.compact(spark, path, files.CORPUS)
    assert held(spark, path) == {"a": "2", "b": "3"} and log.clean(spark, path) == 2 and held(spark, path) == {"a": "2", "b": "3"}


def test_broken_lines_have_their_place_and_reason(spark, tmp_path):
    path = tmp_path / "lines.jsonl"
    lines = [json.dumps({"id": f"c-{i}", "text": "x" * 40}) for i in range(3000)]
    for i, bad in {0: "no", 1500: '{"text": "t"}', 1501: "", 2999: '{"id": "x'}.items():
        lines[i] = bad
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.broken_lines(spark, str(path), files.CORPUS).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], r["reason"], r["value"]) for r in got) == [(1, "no JSON", "no"), (1501, "no id", '{"text": "t"}'), (3000, "no JSON", '{"id": "x')]
    assert files.line_counts(spark, str(path), files.CORPUS).first().asDict() == {"good": 2996, "no_json": 2, "no_id": 1}
    assert "skipped 2 lines that are no JSON and 1 without an id, kept 2996" in files.skipped(spark, str(path), files.CORPUS)


def test_unreadable_prediction_files_are_listed(spark, tmp_path):
    path = str(tmp_path / "p")
    good = spark.createDataFrame([("q", "yes", "r", 1.0, False)], files.PREDICTIONS)
    files.append_predictions(good, path)
    (tmp_path / "p" / "part-9.parquet").write_bytes(b"PAR1 cut off")
    assert [r["file"].rsplit("/", 1)[1] for r in files.unreadable_files(spark, path).collect()] == ["part-9.parquet"]
    assert files.scan_predictions(spark, path).count() == 1
    assert files.unreadable_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("made", [False, True])
def test_no_rows(spark, tmp_path, made):
    if made:
        (tmp_path / "none").mkdir()
    assert files.scan_corpus(spark, str(tmp_path / "none")).count() == 0
    assert files.skipped(spark, str(tmp_path / "none"), files.CORPUS) is None


def test_scratch_leaves_nothing_behind(spark):
    import os

    from factloom.operators.numbering import number_rows
    from factloom.sources.storage import scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark):
        assert number_rows(spark.range(9).toDF("x"), ["x"]).count() == 9
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
