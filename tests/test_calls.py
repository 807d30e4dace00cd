import json
import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.operators import calls, verdict
from factloom.plans.runs import Evaluation, run_evaluation
from factloom.sources import files

ASKED = "id string, text string, keywords array<string>, messages array<struct<role:string,content:string>>"


def asked(spark, n, parts=1):
    return spark.createDataFrame([(f"q-{i}", f"t{i}", ["k"], [("system", "s"), ("user", str(i))]) for i in range(n)], ASKED).repartition(parts)


def test_a_hundred_calls_of_one_task_overlap(spark):
    def chat(messages):
        time.sleep(0.1)
        if int(messages[-1]["content"]) % 10 == 3:
            raise OSError("no line")
        return json.dumps({"answer": "yes", "reasoning": messages[-1]["content"]})

    df = verdict.verdicts(asked(spark, 100), chat, attempts=1, width=10)
    df.collect()  # workers are up
    began = time.time()
    got = df.collect()
    assert time.time() - began < 2 + 0.1 * 100 / 10
    assert {r["id"]: r["reasoning"] for r in got} == {f"q-{i}": None if i % 10 == 3 else str(i) for i in range(100)}
    assert sum(r["failed"] for r in got) == 10 and len(got) == 100
    # as they are: one after the other they take ten seconds
    assert sorted(got) == sorted(verdict.verdicts(asked(spark, 100, 4), chat, attempts=1, width=3).collect())


def test_window_rate_and_back_pressure():
    running, most, taken = [0], [0], []
    lock = threading.Lock()

    def call(x):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01 * (x % 3))
        with lock:
            running[0] -= 1
        return x * x

    def source():
        for x in range(50):
            taken.append(x)
            yield x

    stream = calls.in_flight(source(), call, 7)
    first = next(stream)
    assert len(taken) <= 8  # nothing is taken ahead
    assert sorted([first, *stream]) == [(x, x * x) for x in range(50)] and 1 < most[0] <= 7
    began = time.monotonic()
    assert len(list(calls.in_flight(iter(range(10)), call, 7, rate=50))) == 10 and time.monotonic() - began >= 9 / 50
    with pytest.raises(ZeroDivisionError):
        list(calls.in_flight(iter([1, 0]), lambda x: 1 / x, 2))
    assert list(calls.in_flight(iter([]), call)) == []


def test_no_reply_in_time_is_an_attempt():
    def chat(messages):
        time.sleep(5)

    began = time.time()
    assert verdict.ask(chat, [{}], 2, 0, timeout=0.1) == (None, None, "", 2, True) and time.time() - began < 2


def test_a_chat_gets_the_sampling_it_takes():
    seen = []
    verdict.sampled(lambda m, temperature: seen.append(temperature), verdict.SAMPLING)([])
    verdict.sampled(lambda m, **given: seen.append(given), {"top_p": 0.5})([])
    verdict.sampled(lambda m: seen.append(m), verdict.SAMPLING)([])
    assert seen == [verdict.SAMPLING["temperature"], {"top_p": 0.5}, []]


def test_chunks_are_bounded_and_called_once(spark, tmp_path):
    rows = calls.in_chunks(spark.range(1000).repartition(3), 70)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.groupBy("chunk").count().agg({"count": "max"}).first()[0] <= 70
    folder, mark = f"file://{tmp_path}/out", tmp_path / "calls"
    mark.mkdir()

    def call(r):
        open(f"{mark}/{uuid.uuid4().hex}", "w").close()
        return r["id"], r["id"] * 2

    for again in (False, True):
        ledger = calls.called_by_chunks(rows, call, "id long, twice long", folder).collect()
        assert sum(r["done"] for r in ledger) == 1000 and sum(r["called"] for r in ledger) == (0 if again else 1000)
        assert len(os.listdir(mark)) == 1000
    got = calls.results(spark, folder, "id long, twice long")
    assert got.count() == 1000 and got.where("twice <> 2 * id").count() == 0


QUERIES = "id string, text string, linked_articles array<string>, relevant_articles array<string>, keywords array<string>"


def test_a_broken_run_repeats_at_most_one_chunk_a_task(spark, tmp_path):
    mark = tmp_path / "calls"
    mark.mkdir()
    queries = spark.createDataFrame([(f"q-{i}", f"f{i}", [], [], ["k"]) for i in range(120)], QUERIES).repartition(2)

    def chat_until(limit):
        def chat(messages):
            if len(os.listdir(mark)) >= limit:
                os._exit(1)  # the worker is gone
            open(f"{mark}/{uuid.uuid4().hex}", "w").close()
            return json.dumps({"answer": "yes", "reasoning": "k"})

        return chat

    options, folder = Evaluation(model="m", pause=0.0, chunk=10, max_threads=2), str(tmp_path / "run")
    with pytest.raises(Exception):  # noqa: B017  (whatever Spark makes of a lost worker)
        run_evaluation(queries, None, chat_until(60), options, folder)
    before = len(os.listdir(mark))
    r = run_evaluation(queries, None, chat_until(10**9), options, folder).first()
    assert r["accuracy"] == 1.0 and r["stats"] == {"yes": 120}
    repeated = len(os.listdir(mark)) - 120
    assert before >= 60 and 0 <= repeated <= 10 * spark.sparkContext.defaultParallelism and repeated < before
    assert files.read_lines(spark, f"{folder}/outputs", "id string").count() == 0  # outputs have no id
    assert files.log.read(spark, f"{folder}/outputs", "prompt string, prediction string").count() == 120
    assert files.scan_predictions(spark, f"{folder}/predictions").select("id").distinct().count() == files.scan_predictions(spark, f"{folder}/predictions").count() == 120
    run_evaluation(queries, None, chat_until(0), options, folder)  # nothing is left to ask
    assert len(os.listdir(mark)) == 120 + repeated


def test_thinking_can_be_turned_off(spark, tmp_path):
    queries = spark.createDataFrame([("q", "f", [], [], ["k"])], QUERIES)
    run_evaluation(queries, None, lambda m: json.dumps({"answer": "yes", "reasoning": "k"}), Evaluation(no_think=True), str(tmp_path / "run"))
    row = files.log.read(spark, str(tmp_path / "run" / "outputs"), "prompt string, output string").first()
    assert row["prompt"].endswith("/no_think") and json.loads(row["output"]) == {"answer": "yes", "reasoning": "k"}
    assert files.scan_predictions(spark, str(tmp_path / "run" / "predictions")).select(F.round("coverage")).first()[0] == 1.0


def test_only_a_slice_of_a_batch_becomes_python_objects():
    import pyarrow as pa

    from factloom.operators import calls

    taken = []

    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def slice(self, at, n):
            taken.append(at)
            return self.batch.slice(at, n)

    rows = calls._rows(iter([Batch(pa.RecordBatch.from_pydict({"a": list(range(200))}))]))
    assert next(rows) == {"a": 0} and taken == [0]
    assert [r["a"] for r in rows] == list(range(1, 200)) and taken == list(range(0, 200, calls.SLICE))
