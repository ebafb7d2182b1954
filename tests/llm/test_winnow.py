import hashlib
import random
import re

import pytest

from usagelens.llm.winnow import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[tuple(w[p : p + n])]
        names = ",".join(sorted(found))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def corpus(seed, short):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Cc", "ÉÀ", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([13, 14, 30, 40, 20])] + [(90, "b " * 20), (91, "b " * 20), (7, None), (8, ""), (None, say(15))]
    if short:
        items += [(20, "Zz yy"), (21, "one"), (22, say(12)), (23, say(8)), (24, "!!")]
    docs = []
    for d in range(40):
        parts = [say(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, 4)
            parts += [" - ".join(w[a : a + rng.randrange(5, 40)]), say(rng.randrange(0, 80))]
        docs.append((d, "; ".join(parts)))
    return [*docs, (100, None), (101, ""), (102, "b " * 13), (103, "B, b " * 300), (104, "one"), (105, "...")], items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("windows", [10**6, 0])
def test_equals_brute_force(spark, short, windows):
    docs, items = corpus(5 + short, short)
    d = spark.createDataFrame([(*x, "e", 1, "w") for x in docs], "doc_id long, text string, words string, h int, item string")
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, size int")
    got = contamination(d, i, broadcast_windows=windows).collect()
    want = brute(docs, [x for x in items if x[0] is not None])
    # A window of an item without a number is hit, and names nothing.
    plain = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}
    every = brute(docs, items)
    assert {k: (v[0], v[1], v[4]) for k, v in plain.items()} == {k: (v[0], v[1], v[4]) for k, v in every.items()}
    assert {k: (v[2], v[3]) for k, v in plain.items()} == {k: (v[2], v[3]) for k, v in want.items()}
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())


def test_keys_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "b " * 13), (1, "b " * 13), (None, "b " * 13), (2, "c")], "doc_id long, text string")
    i = spark.createDataFrame([(5, "b " * 13)], "item_id long, text string")
    for windows in (10, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in contamination(d, i, broadcast_windows=windows).collect()}
        assert got == {1: (13, 13, ["5"]), None: (13, 13, ["5"]), 2: (1, 0, [])}
    assert contamination(d.limit(0), i).collect() == []
    assert {r.n_hit for r in contamination(d, i.limit(0)).collect()} == {0}


def test_main_path_is_native(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
