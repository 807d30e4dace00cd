"""The registered queries themselves, on a small folder of tables, against SQL or plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from factloom.llm.queries import QUERIES, SQL

from .helpers import documents, frame, lower, prose
from .test_classifiers import base
from .test_repeats import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, r = tmp_path_factory.mktemp("tables"), random.Random(11)
    rows = [(i, *x[1:5]) for i, x in enumerate(documents(5))]
    rows.append((len(rows), prose(r, 230_000), "en", "a", 7))  # above a megabyte
    frame(spark, rows, DOCS).write.parquet(str(path / "documents.parquet"))
    frame(spark, rows[:-1], DOCS).write.parquet(str(path / "small" / "documents.parquet"))  # where the plain version is slow on a long text
    pages = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 3), None) for i in range(50)] + [(None, None, None, None), (3, "again", None, None), (50, "long", prose(r, 150_000), None)]
    turns = [(c, i if i else None, r.choice(["user", None]), prose(r, 5, ["a", "b", "c"]) if i % 3 else "hello", 1) for c in range(0, 90, 2) for i in range(r.randint(1, 6))]
    for where in (path, path / "small"):  # labels have columns that documents have too
        frame(spark, [(i, i % 3 != 0 and 1 or 0, i % 2, "x") for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int, text string").write.parquet(str(where / "labels.parquet"))
        frame(spark, pages, "page_id long, url string, html string, digest string").write.parquet(str(where / "pages.parquet"))
        frame(spark, turns, "conv_id long, turn long, role string, text string, depth long").write.parquet(str(where / "conversations.parquet"))
    g = np.random.default_rng(3)
    v = g.normal(size=(90, 6)).round(2)
    vectors = [(i, v[i].tolist()) for i in range(90)] + [(20, v[20].tolist()), (20, v[7].tolist()), (40, None), (41, [0.0] * 6), (43, [float("nan")] * 6), (None, v[1].tolist())]
    frame(spark, vectors, "vec_id long, embedding array<double>").write.parquet(str(path / "embeddings.parquet"))
    return str(path), rows, vectors


def by_id(spark, name, folder):
    got = QUERIES[name](spark, folder[0]).collect()
    out = {x["doc_id"]: x for x in got}
    assert len(out) == len(got) == len(folder[1])
    return out


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, folder, name):
    db = duckdb.connect()
    for name_ in ("documents", "labels", "pages", "conversations"):
        db.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{folder[0]}/small/{name_}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder[0] + "/small").toPandas(), db.execute(SQL[name]).df()
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x  # noqa: E731  (longs with nulls come as floats)
    rows = lambda f: sorted(repr([plain(x) for x in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    from factloom.llm.pretokens import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op1_packing"](spark, folder[0]).collect()
    for i, text, *_ in folder[1][:-1]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for x in sorted((x for x in got if x["doc_id"] == i), key=lambda x: x["start"]):
            piece = np.array(ids[at : at + x["length"]], "<u4").tobytes()
            assert (x["start"], x["ids_crc32"], x["doc_tokens"]) == (at, zlib.crc32(piece), len(ids))
            at += x["length"]
        assert at == len(ids)
    fill = Counter()
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill[x["sequence_id"]]
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 2048 * (len(fill) - 1) * 0.99


def test_repeats(spark, folder):
    small = folder[1][:-1]
    got = {x["doc_id"]: x for x in QUERIES["op3_repeats"](spark, folder[0] + "/small").collect()}
    for (i, text, *_), want in zip(small, brute([x[1] for x in small], 200), strict=True):
        x, raw = got[i], (text or "").encode()
        assert (x["n_bytes"], x["n_removed"]) == (len(raw), want[1])
        assert want[1] or (x["n_spans"], x["kept_sha256"]) == (0, hashlib.sha256(raw).hexdigest())


def test_language(spark, folder):
    got = by_id(spark, "op5_language", folder)
    for i, text, *_ in folder[1]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= got[i]["score"] <= 1
    assert {x["lang_pred"] for x in got.values()} <= {"en", "de", "und"}


def test_neighbours(spark, folder):
    rows = [(i, np.array(v)) for i, v in folder[2] if i is not None and v is not None and np.isfinite(v).all() and any(v)]
    want = Counter()
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(v @ w), j) for k, (j, w) in enumerate(rows) if k != q)[:20]
            want.update((i, r, j, round(-s, 9)) for r, (s, j) in enumerate(near, 1))
    got = Counter((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in QUERIES["op6_neighbours"](spark, folder[0]).collect())
    assert sum((got & want).values()) >= 0.95 * sum(want.values()) and sum(got.values()) == sum(want.values())


def test_quality_and_toxicity(spark, folder):
    got = by_id(spark, "op7_quality", folder)
    for i, text, *_ in folder[1][:-1]:
        x, want = got[i], base(text)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert not (x["base_failed"] and x["kept"])
    again = by_id(spark, "op7_quality", folder)
    assert all(got[i]["kept"] == again[i]["kept"] for i in got)
    toxic = by_id(spark, "op4_toxicity", folder)
    assert all(0 <= x["severity"] <= 3 and x["grade"] in range(4) for x in toxic.values())


def test_language_model(spark, folder):
    got = by_id(spark, "op9_maxent", folder)
    tokens = {i: [*lower((text or "").encode()).split(), None] for i, text, *_ in folder[1]}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(t for i in tokens if not held[i] for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        want = sum(k * math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t, k in Counter(ts).items())
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(x["base_score"], want, rel_tol=1e-9) and x["score"] < 0


def test_token_counts(spark, folder):
    assert len(QUERIES["op10_token_counts"](spark, folder[0]).collect()) >= len(folder[1])


def test_empty_tables(spark, tmp_path):
    frame(spark, [], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    frame(spark, [], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    frame(spark, [], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for query in QUERIES.values():
        assert query(spark, str(tmp_path)).count() == 0
