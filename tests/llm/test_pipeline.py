from collections import Counter

import corpus_pipeline
from factloom.llm.common import store

from .helpers import documents, frame, groups, prose, shingles
from .test_repeats import brute


def fixture(spark, tmp_path):
    import random

    r = random.Random(6)
    words = [f"{c}{i}" for c in "abcdefgh" for i in range(40)]
    passage = prose(r, 60, words)
    texts = [prose(r, 90, words) for _ in range(30)]
    texts += [texts[0], texts[1].replace(texts[1].split()[50], "changed", 1), f"{prose(r, 60, words)} {passage} {prose(r, 50, words)}", f"{prose(r, 70, words)} {passage}", "too short", None]
    texts += [t.upper() for t in (prose(r, 80, [w + "!!" for w in words]) for _ in range(12))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), None, None, None) for i, t in enumerate(texts)]
    labels = [(i, 1 if i < 30 else 0, 0) for i in range(48) if i < 30 or i >= 38]
    frame(spark, rows, parts=2).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, str(tmp_path)


def test_stages_one_by_one(spark, tmp_path):
    rows, sf = fixture(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, sf), "test")
        seen.append((name, docs.collect(), after.collect()))
        docs = after
    assert all(tuple(x[2][0].asDict()) == corpus_pipeline.COLUMNS for x in seen[:4])

    _, before, after = seen[0]
    assert {x["doc_id"] for x in after} == set(range(34))

    _, before, after = seen[1]
    first = groups([shingles(x["text"]) for x in before])
    stay = {min(before[i]["doc_id"] for i, f in enumerate(first) if f == g) for g in first}
    assert sorted(x["doc_id"] for x in after) == sorted(stay)

    _, before, after = seen[2]
    want = dict(zip((x["doc_id"] for x in before), brute([x["text"] for x in before], 200), strict=True))
    assert {x["doc_id"] for x in after} == set(want)
    assert all(len(x["text"].encode()) == want[x["doc_id"]][0] - want[x["doc_id"]][1] for x in after)
    assert sum(w[1] for w in want.values()) > 400

    _, before, after = seen[3]
    sizes = Counter()
    for x in before:
        sizes[x["doc_id"]] = len(x["text"].split())
    taken = Counter()
    for x in after:
        taken[x["doc_id"]] += len(x["text"].split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 and all(taken[i] <= 2 * sizes[i] for i in taken)

    _, before, after = seen[4]
    from factloom.llm.pretokens import encoder, tokenizer_path

    enc = encoder(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    assert sum(x["length"] for x in after) == sum(len(enc.slow(x["text"])) + 1 for x in before)
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_stages_take_difficult_rows_and_empty_tables(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame(spark, data), str(tmp_path)).collect()
            assert bool(out) == bool(data)
