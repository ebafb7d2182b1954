import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import subword, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    good = ["river", "stone", "meadow", "cloud", "harvest", "lantern", "orchard"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(good) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(5, 120))]
        low, toxic = rng.random() < 0.3, rng.random() < 0.3
        if low:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = "Grobble" + rng.choice(["", "st", "nik", "ung"]) + rng.choice(["", ",", "."])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not low), int(toxic), "clash"))
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, LABELS), labels


def test_subword_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    model = subword.train(docs, labels, F.col("quality"), bound=600, use=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in subword.score(docs, model).collect()}
    held = [(got[i], q) for i, q, _, _ in truth if i % 5 == 0]
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((s >= 0.3) == bool(q) for s, q in held) >= 0.97 * len(held)


def test_subword_score_equals_the_model_by_hand(spark, corpus):
    docs, labels, _ = corpus
    model = subword.train(docs, labels, F.col("quality"), bound=50, epochs=2)
    few = docs.filter("doc_id < 5")
    rows = few.collect()
    got = {r.doc_id: r.score for r in subword.score(few, model).collect()}
    for r in rows:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        ids = np.concatenate([i for i, _ in subword.features(raw, np.array([0, len(raw)]))])
        p = subword.softmax(model.weights @ model.vectors[ids].mean(axis=0) + model.bias)
        assert abs(got[r.doc_id] - p[1]) < 1e-5


def test_subword_edges(spark, corpus):
    docs, labels, _ = corpus
    model = subword.train(docs, labels, F.col("quality"), bound=50, epochs=1)
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, " \n", 0.5), (2, " \n", 0.5), (3, "é" * 3_000_000, 0.5)], "doc_id long, text string, score double")
    rows = subword.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert subword.score(odd.limit(0), model).collect() == []
    assert subword.train(docs.limit(0), labels, F.col("quality")) is None
    assert subword.train(docs, labels.limit(0), F.col("quality")) is None
    assert {r.score for r in subword.score(odd, None).collect()} == {0.5}


def test_repeated_words_are_marked():
    raw = np.frombuffer(b"a a b b b", np.uint8)
    parts = list(subword.features(raw, np.array([0, 3, 9])))
    assert parts[1][1].tolist() == [2, 6, 8]


NAMES = ["low_quality", "toxic"]


def categories():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def test_chain_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    chain = toxicity.train(docs, labels, categories(), bound=700, use=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, chain, NAMES).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t, _ in truth if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [len(link.earlier) for link in chain] == [0, 1]


def test_later_links_learn_from_out_of_fold_predictions():
    """The second category equals the first, which words tell badly: the chain must not trust what was fitted on the same rows."""
    rng = np.random.default_rng(2)
    ids = [np.unique(rng.integers(0, 3000, 40)) for _ in range(400)]
    y = rng.integers(0, 2, (400, 1))
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows))
    chain = toxicity.fit_chain(*flat(ids), np.hstack([y, y]), least=1)
    # Noise alone: predictions on unseen rows say nothing, so the weight on them stays small.
    assert abs(chain[1].earlier[0]) < 2
    informed = [np.append(x, 5000 + int(v)) for x, v in zip(ids, y[:, 0], strict=True)]
    chain = toxicity.fit_chain(*flat(informed), np.hstack([y, y]), least=1)
    assert chain[1].earlier[0] > 0.5


def test_chain_edges(spark, corpus):
    docs, labels, _ = corpus
    chain = toxicity.train(docs, labels, categories(), bound=100)
    odd = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, "!!", 1), (2, "!!", 1), (3, "word " * 100_000, 1)], "doc_id long, text string, toxic int")
    rows = toxicity.score(odd, chain, NAMES).collect()
    assert len(rows) == 5 and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), chain, NAMES).collect() == []
    assert toxicity.train(docs, labels.limit(0), categories()) == []
    assert {(r.p_toxic, r.toxic) for r in toxicity.score(odd, [], NAMES).collect()} == {(0.0, False)}


def plain_features(text):
    """Words in lower case, and the beginnings of longer ones, each once."""
    found = set()
    for word in re.findall(r"[a-z0-9]+", text.lower()):
        found |= {word} | {(n, word[:n]) for n in (4, 5, 6) if len(word) > n}
    return found


def plain_probability(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def plain_link(rows, extra, y, rounds=150, l1=2.0, rate=0.3):
    """L1 logistic regression by loops over documents and their features."""
    names = sorted(set().union(*rows), key=str)
    w, gw = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1e-3)
    e, ge = [0.0] * len(extra[0]), [1e-3] * len(extra[0])
    b, gb = math.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5)), 1e-3
    for _ in range(rounds):
        slope, tilt, lift = dict.fromkeys(names, 0.0), [0.0] * len(e), 0.0
        for row, x, target in zip(rows, extra, y):
            error = plain_probability(sum(w[f] for f in row) + sum(p * q for p, q in zip(x, e)) + b) - target
            lift += error
            for f in row:
                slope[f] += error
            tilt = [g + p * error for g, p in zip(tilt, x)]
        for f in names:
            gw[f] += slope[f] ** 2
            step = rate / math.sqrt(gw[f])
            moved = w[f] - step * slope[f]
            w[f] = math.copysign(max(abs(moved) - step * l1, 0.0), moved)
        ge = [g + t * t for g, t in zip(ge, tilt)]
        e = [v - rate * t / math.sqrt(g) for v, t, g in zip(e, tilt, ge)]
        gb += lift * lift
        b -= rate * lift / math.sqrt(gb)
    return lambda row, x: plain_probability(sum(w.get(f, 0.0) for f in row) + sum(p * q for p, q in zip(x, e)) + b)


def test_chain_equals_a_plain_one(spark):
    """Same features, same folds, same steps: equal probabilities, also of a link that needs the one before it."""
    rng = random.Random(7)
    words = ["amber", "birches", "cat", "dunes", "evening", "fern", "gravelly", "harbours"]
    docs, labels = [], []
    for i in range(100, 190):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        low = rng.random() < 0.4
        toxic = low and rng.random() < 0.8
        docs.append((i, " ".join(text + ["Rubbishy"] * low + ["cat"] * toxic) + "!"))
        labels.append((i, int(not low), int(toxic), "x"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.train(table, spark.createDataFrame(labels, LABELS), categories(), bound=1000)
    got = {r.doc_id: [r[f"p_{c}"] for c in NAMES] for r in toxicity.score(table, chain, NAMES).collect()}

    rows = [plain_features(t) for _, t in docs]
    counts = Counter(f for row in rows for f in row)
    rows = [{f for f in row if counts[f] >= 8} for row in rows]
    part = np.random.default_rng(1).integers(0, 4, len(rows))
    fed, shown = [[] for _ in rows], [[] for _ in rows]
    for y in ([1 - q for _, q, _, _ in labels], [t for _, _, t, _ in labels]):
        unseen = [0.0] * len(rows)
        for fold in range(4):
            inside = [i for i in range(len(rows)) if part[i] != fold]
            model = plain_link([rows[i] for i in inside], [fed[i] for i in inside], [y[i] for i in inside])
            unseen = [model(rows[i], fed[i]) if part[i] == fold else u for i, u in enumerate(unseen)]
        model = plain_link(rows, fed, y)
        shown = [s + [model(r, s)] for r, s in zip(rows, shown)]
        fed = [x + [u] for x, u in zip(fed, unseen)]
    assert all(got[i] == pytest.approx(want, abs=1e-4) for (i, _), want in zip(docs, shown))
    assert len({round(p[1], 3) for p in got.values()}) > 5


def test_counts_are_packed_on_their_way_to_the_driver():
    rng = np.random.default_rng(5)
    rows = []
    for y in (0, 1, 0, 1):
        ids = np.unique(rng.integers(0, 1 << subword.BITS, 1600))
        rows.append((ids, rng.integers(1, 300, len(ids)), y))
    rows.append((np.zeros(0, np.int64), np.zeros(0, np.int64), 1))
    rows.append((np.array([0, (1 << subword.BITS) - 1]), np.array([70_000, 1]), 0))
    data = [subword.packed(i, n) for i, n, _ in rows]
    for d, (i, n, _) in zip(data, rows, strict=True):
        ids, counts = subword.unpacked(d)
        assert ids.tolist() == i.tolist() and counts.tolist() == n.tolist()
    # Two numbers of four bytes each before.
    assert all(len(d) < 4 * len(i) for d, (i, _, _) in zip(data[:4], rows, strict=False))
    plain, lazy = subword.fit(rows), subword.fit(subword.PackedRows(data, [y for _, _, y in rows]))
    assert (plain.vectors == lazy.vectors).all() and (plain.weights == lazy.weights).all() and (plain.bias == lazy.bias).all()


def test_scoring_holds_little_beside_a_batch():
    """A worker's arrays follow a small chunk, not the batch: two workers share an executor's memory with its JVM."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from usagelens.llm import subword

    texts = pa.array([f"some words of text {i} and more of them " * 40 for i in range(2500)] + [None, ""])
    table = np.linspace(-1, 1, 1 << subword.BITS, dtype=np.float32)
    whole = subword.batch_scores(texts.slice(0, 3), table, 0.1)
    tracemalloc.start()
    try:
        found = subword.batch_scores(texts, table, 0.1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20
    np.testing.assert_allclose(found[:3], whole, rtol=1e-9)
    assert found[-1] == found[-2] == 1 / (1 + np.exp(-0.1))
