"""Calls to the outside from within a task: a window of calls in flight, and results that are kept chunk by chunk."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.storage import exists

#: Fixed value: calls of one task at a time.
WIDTH = 10
#: Rows of a chunk: what is repeated at most for each task of a run that was broken off.
CHUNK = 200
#: Rows of a batch that a task has as Python objects at a time.
SLICE = 64
_LEDGER = "chunk long, attempt long, done long, called long, file string"


def timed(call: Callable, seconds: float | None) -> Callable:
    """``call``, which raises TimeoutError if it takes longer; what it is waiting for is left behind in its thread."""
    if not seconds:
        return call

    def limited(*args):
        got: queue.SimpleQueue = queue.SimpleQueue()

        def work():
            try:
                got.put((True, call(*args)))
            except BaseException as e:  # handed over to whoever waits
                got.put((False, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            well, value = got.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no reply in {seconds} seconds") from None
        if not well:
            raise value
        return value

    return limited


def in_flight(items: Iterator, call: Callable, width: int = WIDTH, rate: float | None = None) -> Iterator[tuple]:
    """(item, call(item)) as the calls finish, at most ``width`` of them at a time and ``rate`` begun in a second. The next item is taken when
    there is a place for it, so a slow consumer or slow calls hold back the source. What a call raises is raised here."""
    items, finished, running, ended, begin = iter(items), queue.SimpleQueue(), 0, False, time.monotonic()

    def work(item):
        try:
            finished.put((item, call(item), None))
        except BaseException as e:
            finished.put((item, None, e))

    while True:
        while not ended and running < width and (wait := begin - time.monotonic()) <= 0:
            try:
                item = next(items)
            except StopIteration:
                ended = True
                break
            threading.Thread(target=work, args=(item,), daemon=True).start()
            running += 1
            if rate:
                begin = max(begin, time.monotonic() - 1 / rate) + 1 / rate
        if not running:
            if ended:
                return
            time.sleep(max(0.0, begin - time.monotonic()))
            continue
        try:
            item, value, error = finished.get(timeout=None if ended or running >= width else max(0.001, wait))
        except queue.Empty:
            continue
        running -= 1
        if error is not None:
            raise error
        yield item, value


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches; only those of a slice are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield from b.slice(i, SLICE).to_pylist()


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def called(rows: DataFrame, call: Callable[[dict], tuple], schema: str | StructType, width: int = WIDTH, rate: float | None = None, flush: int = 64) -> DataFrame:
    """A row for each row of ``rows``, made of what ``call`` gives for it, in the order in which calls finish. A task that is run again calls
    again: see called_by_chunks()."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, got in in_flight(_rows(batches), call, width, rate):
            out.append(got)
            if len(out) >= flush:
                yield _batch(out, kinds)
                out = []
        if out:
            yield _batch(out, kinds)

    return rows.mapInArrow(run, schema)


def in_chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``rows`` with a ``chunk`` of at most ``size`` of them; store the result, so that chunks stay what they are."""
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    return rows.withColumn("chunk", F.shiftright(at, 33) * F.lit(1 << 31) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / size))


def called_by_chunks(rows: DataFrame, call: Callable[[dict], tuple], schema: str | StructType, folder: str, width: int = WIDTH, rate: float | None = None, tasks: int | None = None) -> DataFrame:
    """The same for stored rows with a ``chunk``, whose results go to a file in ``folder`` for each chunk -> ledger: chunk, attempt, done, called.

    A chunk's file gets its name when all its calls are done, so a task that is run again, on another executor or in another run over the
    same folder, leaves out the chunks that have one. A run that is broken off repeats at most one chunk a task. results() reads the files.
    ``folder`` is a URI that pyarrow's file systems reach.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    tasks = tasks or max(1, min(rows.select("chunk").distinct().count(), 4 * rows.sparkSession.sparkContext.defaultParallelism))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        held: list[dict] = []
        for r in _rows(batches):
            if held and held[0]["chunk"] != r["chunk"]:
                yield held[0]["chunk"], held
                held = []
            held.append(r)
        if held:
            yield held[0]["chunk"], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for chunk, items in chunks(batches):
            file = f"{top}/chunk-{chunk:020d}.parquet"
            fresh = fs.get_file_info(file).type == pyarrow.fs.FileType.NotFound
            if fresh:
                got = [value for _, value in in_flight(items, call, width, rate)]
                table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)
                draft = f"{top}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    pq.write_table(table, out)
                fs.move(draft, file)
            line = [[chunk], [attempt], [len(items)], [len(items) if fresh else 0], [file]]
            yield pa.RecordBatch.from_arrays([pa.array(line[0], pa.int64()), pa.array(line[1], pa.int64()), pa.array(line[2], pa.int64()), pa.array(line[3], pa.int64()), pa.array(line[4])], names=["chunk", "attempt", "done", "called", "file"])

    return rows.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(run, _LEDGER)


def results(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """What is in the finished chunks of a folder; nothing if none was begun."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "chunk-*.parquet").parquet(folder)
