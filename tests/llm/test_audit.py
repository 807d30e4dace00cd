import itertools

import numpy as np

from factloom.llm.audit import LETTERS, audit_filters, cells, failure_masks, single_swaps, walk

from .helpers import documents, frame

LABELS = "doc_id long, quality int, toxic int, text string, source string"


def plain(rows, labels):
    """Every order applied filter by filter to every document."""
    good = {x[0] for x in labels if x[1] == 1 and x[0] is not None}
    toxic = {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    docs = []
    for r in rows:
        t = r[1] or ""
        w = [x for x in t.encode().split()]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": r[0] is not None and r[0] > least[t],
        }
        docs.append((r[3] or "", fails, r[0] in good, r[0] in toxic))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations(LETTERS)):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                total[part, x] = total.get((part, x), 0) + len(gone)
                failing = [d for d in own if d[1][x]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_every_order_applied(spark):
    rows = documents(3)
    rows += [(500 + i, "COPY Copy copy " * 30, "en", "a" if i % 2 else "", 1, "", 0, "") for i in range(40)]
    rows += [(900, "£ § é €" * 60, "en", "ü", 1, "", 0, ""), (901, "A$B " * 60, "en", "b", 1, "", 0, ""), (902, "w" * 1_200_000 + " A", "en", "b", 1, "", 0, "")]
    labels = [(i, i % 2, (i + 1) % 3 and 1, "x", "y") for i in range(0, 60, 2)] + [(4, 0, 0, None, None), (4, 1, None, None, None), (None, 1, 1, None, None), (10**9, 1, 1, "", "")]
    want = plain(rows, labels)
    for parts in (1, 5):
        got = audit_filters(frame(spark, rows, parts=parts), frame(spark, labels, LABELS)).collect()
        assert len(got) == len(want) == 120 * 5 * len({r[3] or "" for r in rows})
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got} == want


def test_no_documents_and_no_labels(spark):
    assert audit_filters(frame(spark, []), frame(spark, [], LABELS)).count() == 0
    got = audit_filters(frame(spark, [(None, None, None, None, None, None, None, None)]), frame(spark, [], LABELS)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""}
    assert all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in got)


def test_each_order_differs_from_the_one_before_by_one_swap():
    orders = list(single_swaps(5))
    assert len({o for o, _ in orders}) == len(orders) == 120
    for (a, _), (b, at) in itertools.pairwise(orders):
        assert [i for i in range(5) if a[i] != b[i]] == [at, at + 1]


def test_shapley_sums_share_out_what_is_removed():
    counts = np.random.default_rng(1).integers(0, 9, (3, 3, 32))
    names, found = walk(counts)
    each = {x: found["shapley"][:, 0, names[0].index(x)] for x in LETTERS}
    assert (sum(each.values()) == 120 * counts[:, 0, 1:].sum(1)).all()


def test_a_hot_part_is_counted_in_few_cells(spark):
    masks = failure_masks(frame(spark, [(i, "same text", "en", "hot", 1, "", 0, "") for i in range(5000)], parts=4), frame(spark, [], LABELS))
    assert sorted((r["mask"], r["n"]) for r in cells(masks).collect()) == [(1, 1), (17, 4999)]
