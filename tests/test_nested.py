import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.sources import files
from factloom.sources.nested import members, pieces
from factloom.sources.storage import qualified


def export(seed, years, facts):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "я", "a", " ", "\n", '\\"']) for _ in range(r.randint(0, 30)))
    fact = lambda: {"section": text(), "text": text(), "links": [text() for _ in range(r.randint(0, 3))], "relevant_links": None}
    return {str(2000 + y): {m: [fact() for _ in range(r.randint(0, facts))] for m in r.sample(["Mai", "Juni", 'J"uli', "März"], r.randint(0, 4))} for y in range(years)}


def flat(raw):
    return sorted((y, m, i, f["section"], f["text"], tuple(f["links"])) for y, ms in raw.items() for m, fs in ms.items() for i, f in enumerate(fs))


def got(df):
    return sorted((r["year"], r["month"], r["item"], r["section"], r["text"], tuple(r["links"])) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("width", [17, 1000])
def test_ranges_that_begin_anywhere(spark, tmp_path, indent, width):
    raw = export(width, 12, 4)
    (tmp_path / "f.json").write_text(json.dumps(raw, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert got(files.scan_facts(spark, str(tmp_path / "f.json"), width)) == flat(raw)


def test_one_file_of_many_years_is_read_by_several_tasks(spark, tmp_path):
    raw = export(5, 300, 30)
    (tmp_path / "big.json").write_text(json.dumps(raw, indent=1))
    (tmp_path / "small.json").write_text('{"1999": {"Mai": [{"section": "s", "text": "t", "links": []}]}}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("{ \n }" + " " * 70_000)
    facts = files.scan_facts(spark, str(tmp_path), 60_000).withColumn("task", F.spark_partition_id())
    assert got(facts) == sorted([*flat(raw), ("1999", "Mai", 0, "s", "t", ())])
    assert facts.where("year <> '1999'").select("task").distinct().count() >= 8
    size = (tmp_path / "big.json").stat().st_size
    found = members(spark.createDataFrame([(qualified(spark, str(tmp_path / "big.json")), size)], "path string, bytes long"), 60_000).collect()
    assert len(found) == 300 and max(r["end"] - r["start"] for r in found) < size / 50


def test_one_year_is_read_in_pieces(spark, tmp_path):
    """However large a year or a month is, a task holds a range and a fact of it; a year that isn't ended is left out, as are members of other kinds."""
    facts = [{"section": str(i), "text": '],"}{[' * (i % 50), "links": [], "relevant_links": None} for i in range(4000)]
    raw = {"2001": {'M"ai': facts, "Juni": [], "Juli": facts[:3]}}
    path = tmp_path / "year.json"
    path.write_text(json.dumps(raw, indent=1))
    file = spark.createDataFrame([(qualified(spark, str(path)), path.stat().st_size)], "path string, bytes long")
    found = pieces(file, 20_000).collect()
    assert len(found) > 30 and max(r["end"] - r["start"] for r in found) < 21_000
    read = files.scan_facts(spark, str(path), 20_000)
    assert got(read) == flat(raw)
    assert read.select(F.spark_partition_id()).distinct().count() >= 8
    odd = '{"1999": null, "2000": {"Mai": null, "Juni": {"a": [1, 2]}}, "2002": [[1, 2]], ' + json.dumps(raw)[1:-1] + ', "2003": {"Mai": [{"section": "cut off"}, {"section": '
    (tmp_path / "odd.json").write_text(odd)
    assert got(files.scan_facts(spark, str(tmp_path / "odd.json"), 20_000)) == flat(raw)


def test_years_are_written_line_by_line(spark, tmp_path):
    """The same export as from a row for each year, with a fact on a line and each year in one file."""
    r = random.Random(7)
    rows = [(y, m, i, f'{y} "{m}"\n{i}', None if i == 2 else "x" * r.randint(0, 9), ["l"] * (i % 3), None) for y in ("1999", "2000", 'o"d\n[d]') for m in ("Mai", "Januar", "März", "]") for i in r.sample(range(40), 12)]
    rows += [("2001", "Mai", 0, "s", "t", [], [])]
    facts = spark.createDataFrame(rows, "year string, month string, item int, section string, text string, links array<string>, relevant_links array<string>").repartition(7)
    files.write_nested(files.nest_facts(facts), str(tmp_path / "rows"))
    files.write_years(facts, str(tmp_path / "lines"))
    read = lambda name: [p.read_text() for p in (tmp_path / name).glob("part-*") if p.stat().st_size]
    want, lines = ({y: list(ms.items()) for text in texts for y, ms in json.loads(text).items()} for texts in (read("rows"), read("lines")))
    assert lines == want and len(want) == 4
    assert len(read("lines")) == 4 and max(len(x) for text in read("lines") for x in text.splitlines()) < 200
    assert got(files.scan_facts(spark, str(tmp_path / "lines"), 50).fillna("")) == got(files.scan_facts(spark, str(tmp_path / "rows")).fillna(""))
    with pytest.raises(ValueError, match="without year"):
        files.write_years(facts.withColumn("month", F.lit(None).cast("string")), str(tmp_path / "none"))
    files.write_years(facts.where("item < 0"), str(tmp_path / "empty"))
    assert files.scan_facts(spark, str(tmp_path / "empty")).count() == 0
