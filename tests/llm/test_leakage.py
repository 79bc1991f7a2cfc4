import random

import numpy as np

from codeloom.llm.leakage import edit_distances, leaked_items, repetitions
from tests.conftest import rows

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def run(spark, docs, items, **kw):
    return leaked_items(spark.createDataFrame([(*x, "clash") for x in docs], DOCS), spark.createDataFrame([(*x, "clash") for x in items], ITEMS), **kw)


def test_exact_passages(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = [(1, "Before. " + item.upper().replace(" ", ", ") + " after"), (2, " ".join(f"word{i}" for i in range(12))), (3, " ".join(f"word{i}" for i in range(4, 17))), (4, None), (5, ""), (6, "word0 " * 50), (1, "Before. " + item.upper()), (7, "filler " * 200_000 + item), (None, item)]
    items = [(9, item), (9, item), (10, None), (11, ""), (12, "short item"), (13, item + " more"), (None, item)]
    items.append((14, "word3 unknown tail"))
    assert rows(run(spark, docs, items, max_edits=0), "doc_id", "item_id") == [(1, 13), (1, 9), (3, 13), (3, 9), (7, 13), (7, 9)]
    assert rows(run(spark, docs, items, block_bytes=40), "doc_id", "item_id") == [(1, 13), (1, 9), (3, 13), (3, 9), (7, 13), (7, 9)]
    assert rows(run(spark, [], items)) == [] and rows(run(spark, docs, [])) == []


def test_recall_of_changed_passages(spark):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(13))) for i in range(300)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(2):
            p, how = rnd.randrange(len(w)), rnd.randrange(3)
            if how == 0:
                w[p] = rnd.choice(vocab)
            elif how == 1:
                w.insert(p, rnd.choice(vocab))
            else:
                del w[p]
        docs.append((1000 + i, " ".join([*(rnd.choice(vocab) for _ in range(9)), *w, *(rnd.choice(vocab) for _ in range(9))])))
    got = {(r.doc_id, r.item_id): r.edits for r in run(spark, docs, items, max_edits=4, recall=0.95).collect()}
    right = [k for k in got if k[0] == k[1] + 1000]
    assert len(right) >= 0.9 * len(items) and len(right) == len(got)


def test_edit_distances_equal_a_plain_one():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 9))

    def plain(x, y):
        d = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            d, prev = [i], d
            for j, v in enumerate(y, 1):
                d.append(min(prev[j] + 1, d[-1] + 1, prev[j - 1] + (u != v)))
        return d[-1]

    want = [plain(x, y) for x, y in zip(a, b)]
    assert edit_distances(a, b).tolist() == want
    for most in (0, 1, 3, 20):
        got = edit_distances(a, b, most).tolist()
        assert [min(x, most + 1) for x in got] == [min(x, most + 1) for x in want]
    assert repetitions(0, 13, 6, 0.95) == 1 and repetitions(2, 13, 6, 0.99) > repetitions(1, 13, 6, 0.9)


def test_short_items_and_shared_windows(spark):
    docs = [(1, "we saw alpha beta gamma delta epsilon zeta eta here"), (2, "alpha beta gamma delta changed zeta eta"), (3, "tiny alpha beta"), (4, " ".join(["pre"] * 5 + [f"p{i}" for i in range(13)]))]
    same = " ".join(f"p{i}" for i in range(13))
    items = [(7, "alpha beta gamma delta epsilon zeta eta"), (8, "tiny alpha"), (9, ""), *[(100 + i, same + f" own{i} more{i}") for i in range(50)]]
    got = rows(run(spark, docs, items, max_edits=2), "doc_id", "item_id", "edits")
    assert [g for g in got if g[1] < 100] == [(1, 7, 0), (2, 7, 1), (3, 8, 0)]
    assert sorted(g[1] for g in got if g[0] == 4 and g[2] == 0) == list(range(100, 150))
