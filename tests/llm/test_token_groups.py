import random
import re

from usagelens.llm.token_groups import similar_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(s), label[d]) for d, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = say(50)
    texts = []
    for _ in range(12):
        base = say(rng.randrange(5, 200))
        if rng.random() < 0.5:
            base = passage + base
        texts.append(base)
        for _ in range(rng.randrange(0, 12)):
            base = edited(rng, base if rng.random() < 0.7 else texts[-1], rng.randrange(0, max(1, len(base) // 30) + 1))
            texts.append(base)
            if rng.random() < 0.3:
                texts.append(base + say(rng.randrange(0, max(1, len(base) // 8) + 1)))
    base = say(300)  # a large group of near copies, each with its own edits
    texts += [edited(rng, base, rng.randrange(0, 5)) for _ in range(150)]
    docs = [" ".join(t) for t in texts] + [None, "", " \t\n", "a b", "A  b", "a b c d e", "b a c d e", "x", "same words here", "Same\x0bwords here"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 1, "z", "r") for d in docs], "doc_id long, text string, n int, prefix string, rep string").repartition(4)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(df).collect()}
        want = brute(docs)
        assert got == want
        assert len({c for _, c in want.values()}) > 20


def test_links_that_minima_miss_are_found(spark, monkeypatch):
    """Without the first round every link has to come through the matrix."""
    from usagelens.llm import token_groups

    monkeypatch.setattr(token_groups, "MINS", 0)
    docs = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_repeats_null_keys_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (0, None)]
    got = sorted(similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (0, 0, 0)], key=str)
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_text(spark):
    long = " ".join(f"v{i % 5000}" for i in range(300_000))
    got = similar_documents(spark.createDataFrame([(1, long), (2, long + " tail")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
