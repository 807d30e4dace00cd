"""A large JSON object read by several tasks: where its members, or the items of lists in it, begin is found range by range, and pieces of a
range's size are then read by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

#: Bytes of a file that a task looks at, at once.
RANGE_BYTES = 4 << 20
_QUOTE, _BACK, _COMMA = ord('"'), ord("\\"), ord(",")
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))


def _bytes(path: str, start: int, end: int) -> bytes:
    fs, local = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(local) as f:
        f.seek(start)
        return f.read(end - start)


def _escaped(path: str, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    n, at = 0, start
    while at > 0:
        low = max(0, at - 4096)
        before = _bytes(path, low, at)
        run = len(before) - len(before.rstrip(b"\\"))
        n, at = n + run, low
        if run < len(before):
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Whether each byte is a quote that begins or ends a string."""
    back = data == _BACK
    # the length of the run of backslashes right before each byte
    at = np.arange(len(data) + 1)
    free = np.concatenate([[True], ~back])
    last = np.maximum.accumulate(np.where(free, at, 0))
    run = (at - last)[:-1]
    odd = run % 2 == 1
    if escaped:
        lead = np.flatnonzero(~back)
        odd[: (lead[0] if len(lead) else len(data)) + 1] ^= True
    return (data == _QUOTE) & ~odd


def _steps(data: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """+1 and -1 at brackets that are in no string."""
    within = (np.cumsum(quotes) + inside) % 2 == 1
    step = np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8)
    return np.where(within, 0, step)


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    return files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))


def _marks(files: DataFrame, levels: int, range_bytes: int) -> DataFrame:
    """files (path, bytes), a JSON object each -> (path, range, at, depth, byte) of the brackets and commas of its ``levels`` outermost levels,
    with the depth that a bracket leads to.

    A range is looked at without knowing what comes before it: how many quotes it has, and how deep it leads if it begins in a string and if it
    doesn't. Sums over the ranges of a file tell where each of them really begins; in a second pass the commas and brackets are found. A task
    holds one range.
    """
    tasks = max(1, min(files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1, 4 * files.sparkSession.sparkContext.defaultParallelism))
    ranges = _ranges(files, range_bytes).repartition(int(tasks))

    def loaded(r: dict) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(_bytes(r["path"], r["start"], min(r["start"] + range_bytes, r["bytes"])), np.uint8)
        return data, _quotes(data, _escaped(r["path"], r["start"]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, quotes = loaded(r)
                row = [r["path"]], [r["bytes"]], [r["start"]], [int(quotes.sum())], [int(_steps(data, quotes, False).sum())], [int(_steps(data, quotes, True).sum())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["path", "bytes", "start", "quotes", "outside", "within"])

    sums = stored(ranges.mapInArrow(summed, "path string, bytes long, start long, quotes long, outside long, within long"), "ranges")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, quotes = loaded(r)
                step = _steps(data, quotes, r["inside"])
                depth = r["depth"] + np.cumsum(step, dtype=np.int64)
                within = (np.cumsum(quotes) + r["inside"]) % 2 == 1
                at = np.flatnonzero((step == 1) & (depth >= 1) & (depth <= levels) | (step == -1) & (depth < levels) | (data == _COMMA) & (depth >= 1) & (depth <= levels) & ~within)
                columns = [pa.array([r["path"]] * len(at), pa.string()), pa.array([r["start"]] * len(at), pa.int64()), pa.array(at + r["start"], pa.int64()), pa.array(depth[at], pa.int64()), pa.array(data[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "range", "at", "depth", "byte"])

    return known.select("path", "bytes", "start", "inside", "depth").repartition(int(tasks)).mapInArrow(found, "path string, range long, at long, depth long, byte int")


def members(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes), a JSON object each -> (path, start, end) of their members, as many rows as there are keys."""
    following = F.lead("at").over(W.partitionBy("path").orderBy("at"))
    return _marks(files, 1, range_bytes).select("path", (F.col("at") + 1).alias("start"), following.alias("end")).where("end > start")


def pieces(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes), JSON objects {key: {key: [item]}} -> (path, start, end, first, outer, inner): where the items of a list that begin
    in one range stand, the place of their first one in the list, and where the two keys stand. A member that doesn't end is left out."""
    order = W.partitionBy("path").orderBy("at")
    opens, comma = F.col("byte").isin(*_OPEN), F.col("byte") == _COMMA
    item = (F.col("depth") == 3) & (opens | comma)
    ended = F.when((F.col("depth") == 1) & comma | (F.col("depth") == 0), F.col("at"))
    marks = _marks(files, 3, range_bytes).withColumns({
        "before": F.lag("at").over(order), "end": F.lead("at").over(order), "n": F.sum(item.cast("long")).over(order), "ended": F.max(ended).over(W.partitionBy("path")),
    })
    key = F.struct((F.col("before") + 1).alias("start"), F.col("at").alias("end"), "byte", "n")
    marks = marks.withColumns({name: F.last(F.when(opens & (F.col("depth") == d), key), True).over(order) for name, d in (("outer", 2), ("inner", 3))})
    # of lists in objects only: what else stands there has no items
    items = marks.where(item & (F.col("end") < F.col("ended")) & (F.col("outer.byte") == _OPEN[0]) & (F.col("inner.byte") == _OPEN[1]))
    keys = [F.struct(f"{k}.start", f"{k}.end").alias(k) for k in ("outer", "inner")]
    return items.groupBy("path", "range", *keys).agg((F.min("at") + 1).alias("start"), F.max("end").alias("end"), F.min(F.col("n") - F.col("inner.n")).alias("first")).drop("range")


def piece_texts(found: DataFrame) -> DataFrame:
    """pieces() -> (value, first): each piece as an object of its own, {key: {key: [item]}}; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                outer, inner = (_bytes(r["path"], r[k]["start"], r[k]["end"]) for k in ("outer", "inner"))
                text = b"{%s{%s[%s]}}" % (outer, inner, _bytes(r["path"], r["start"], r["end"]))
                yield pa.RecordBatch.from_arrays([pa.array([text], pa.binary()).cast(pa.string()), pa.array([r["first"]], pa.int64())], names=["value", "first"])

    found = stored(found, "pieces")
    return found.repartition(max(1, min(found.count(), 4 * found.sparkSession.sparkContext.defaultParallelism))).mapInArrow(run, "value string, first long")
