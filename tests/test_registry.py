import threading

from factloom.operators.dataset import url_registry
from factloom.streaming.registry import follow_urls, register_urls, registered

MENTION = "idx long, pos int, url string"


def batches(spark):
    rows = [(i, p, f"u/{(i * 7 + p * p) % 40}") for i in range(30) for p in range(3)] + [(31, 0, ""), (32, 0, None)]
    return [spark.createDataFrame([r for r in rows if r[0] // 11 == k], MENTION).repartition(3) for k in range(3)]


def held(df):
    return {r["url"]: r["cid"] for r in df.collect()}


def test_three_batches_one_of_them_twice_are_as_one(spark, tmp_path):
    one, two, three = batches(spark)
    whole = held(url_registry(one.unionByName(two).unionByName(three).where("url <> ''")))
    path, given = str(tmp_path / "r"), []
    for k, b in ((0, one), (1, two), (1, two), (2, three), (0, one)):
        given.append(held(register_urls(b, path, f"b-{k}")))
    assert held(registered(spark, path)) == whole and registered(spark, path).count() == len(whole)
    assert given[1] == given[2] and given[0] == given[4] and not set(given[0]) & set(given[1])


def test_batches_at_once_share_no_number(spark, tmp_path):
    path = str(tmp_path / "r")
    threads = [threading.Thread(target=register_urls, args=(b, path, str(k))) for k, b in enumerate(batches(spark))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = held(registered(spark, path))
    assert registered(spark, path).count() == len(got) and sorted(got.values(), key=lambda c: int(c[2:])) == [f"c-{i}" for i in range(len(got))]


def test_a_stream_goes_on_where_it_failed(spark, tmp_path):
    path, source, checkpoint, seen = str(tmp_path / "r"), tmp_path / "in", str(tmp_path / "c"), []
    source.mkdir()
    one, two, three = batches(spark)

    def follow(fail=False):
        def then(new, number):
            if fail:
                raise OSError("broken off")
            seen.append(held(new))

        follow_urls(spark.readStream.schema(MENTION).parquet(str(source)), path, checkpoint, then)

    one.write.mode("append").parquet(str(source))
    follow()
    two.write.mode("append").parquet(str(source))
    try:
        follow(fail=True)
    except Exception:  # the stream's own kind
        pass
    before = held(registered(spark, path))
    follow()
    three.write.mode("append").parquet(str(source))
    follow()
    assert len(seen) == 3 and {**seen[0], **seen[1]} == before
    assert held(registered(spark, path)) == held(url_registry(one.unionByName(two).unionByName(three).where("url <> ''")))
