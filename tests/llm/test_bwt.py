import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import bwt


def brute(docs, length):
    least = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            least[g] = min(d, least.get(g, d))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [say(60), say(200), "z" * 120, "ab" * 90, say(49)]
    docs = [None, "", "short", shared[1], shared[1], "z" * 300, "z" * 50]
    for _ in range(40):
        docs.append("".join(rng.choice([say(rng.randrange(0, 80)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(1, 6))))
    rng.shuffle(docs)
    return list(enumerate(docs))


@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=12, unique=True), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_merged_order_and_common_prefixes(texts, n_shards):
    """The merge from transforms alone gives the order and prefixes of sorting all rotations."""
    pieces = [t.encode() for t in texts]
    depth = 12
    parts = [bwt.joined(pieces[i::n_shards]) for i in range(min(n_shards, len(pieces)))]
    shards = [bwt.Shard(*p[:3]) for p in parts]
    merged, common = bwt.interleaved([s.last for s in shards], depth)
    seen = [iter(s.start) for s in shards]
    prefixes = []
    for m in merged:
        at = int(next(seen[m]))
        symbols, _, after, *_ = parts[m]
        word = []
        for _ in range(depth):
            word.append(int(symbols[at]))
            at = int(after[at])
        prefixes.append(word)
    assert prefixes == sorted(prefixes)
    lcp = [0] + [next((i for i in range(depth) if a[i] != b[i]), depth) for a, b in zip(prefixes, prefixes[1:])]
    assert common.tolist() == lcp


@given(st.lists(st.text("ab", min_size=8, max_size=30), min_size=1, max_size=14, unique=True))
@settings(max_examples=60, deadline=None)
def test_least_owner(texts):
    pieces, owners = [t.encode() for t in texts], np.arange(len(texts))[::-1] * 3
    want = {}
    for p, o in zip(pieces, owners, strict=True):
        for i in range(len(p) - 7):
            want[p[i : i + 8]] = min(int(o), want.get(p[i : i + 8], 10**9))
    got = bwt.least_owner(pieces, owners, length=8)
    assert [x.tolist() for x in got] == [[want[p[i : i + 8]] for i in range(len(p) - 7)] for p in pieces]


@given(st.text("abc", max_size=200))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_minimizers(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    first, n, mark = bwt.minimizers(raw, 20, 6)
    assert n.sum() == max(0, len(raw) - 19) and (n <= 15).all()
    of = {}
    for a, k, m in zip(first.tolist(), n.tolist(), mark.tolist(), strict=True):
        for i in range(a, a + k):
            assert of.setdefault(t[i : i + 20], m) == m


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, mark int, piece string").repartition(3)
        assert rows_of(bwt.repeated_bytes(df)) == brute(docs, 50)


def test_hot_minimizers_take_the_other_way(spark):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(bwt.repeated_bytes(df, pieces=1)) == brute(docs, 50)


def test_many_batches_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(bwt, "BATCH_BYTES", 100)
    docs = corpus(4)
    assert rows_of(bwt.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs, 50)


def test_spans_null_keys_repeats_and_empty(spark):
    t = "0123456789" * 6
    rows = [(1, t), (1, t), (2, "x" + t + "y"), (None, t), (3, None)]
    got = bwt.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == sorted(
        [("1", 0, [], t.encode()), ("1", 0, [], t.encode()), ("2", 60, [(1, 61)], b"xy"), ("None", 0, [], t.encode()), ("3", 0, [], b"")]
    )
    assert bwt.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@given(st.lists(st.text("abc", min_size=50, max_size=130), min_size=1, max_size=10, unique=True), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_runs_of_symbols_merge_as_single_ones(texts, n_shards):
    """A merge by five symbols a round takes a fifth of the rounds and draws the same lines as one by single symbols."""
    pieces = [t.encode() for t in texts]
    parts = [bwt.joined(pieces[i::n_shards]) for i in range(min(n_shards, len(pieces)))]
    whole = [bwt.Shard(*p[:3]) for p in parts]
    near = [bwt.Shard(*p[:3], depth=50) for p in parts]
    lasts, step = bwt.runs_before(near, [p[1] for p in parts], 50)
    assert step == 5
    merged, common = bwt.interleaved(lasts, 10)
    alone, single = bwt.interleaved([s.last for s in whole], 50)
    lines = np.flatnonzero(common < 10)
    assert lines.tolist() == np.flatnonzero(single < 50).tolist()
    # Places that are equal in fifty symbols have no order.
    assert [sorted(x.tolist()) for x in np.split(merged, lines)] == [sorted(x.tolist()) for x in np.split(alone, lines)]


def test_runs_of_symbols_fit_16_bits():
    rng = np.random.default_rng(1)
    parts = [bwt.joined([rng.integers(0, 255, 90_000, np.uint8).tobytes()])]
    shards = [bwt.Shard(*p[:3], depth=50) for p in parts]
    lasts, step = bwt.runs_before(shards, [p[1] for p in parts], 50)
    assert step == 2 and lasts[0].dtype == np.uint16


def test_texts_are_cut_into_pieces_once(spark, monkeypatch):
    """The minimizers of a text were found three times: for sums, for the rows that these choose from, and for the places."""
    calls = spark.sparkContext.accumulator(0)
    real = bwt.minimizers

    def counted(*a):
        calls.add(1)
        return real(*a)

    monkeypatch.setattr(bwt, "minimizers", counted)
    docs = corpus(5)
    assert rows_of(bwt.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs, 50)
    assert 0 < calls.value <= sum(len((t or "").encode()) >= 50 for _, t in docs)


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), max_size=40), st.lists(st.integers(1, 6), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_rows_of_marks_that_two_documents_have(rows, sizes):
    """Wherever the batches end, and however long a run of one mark is."""
    import pyarrow as pa

    rows = sorted(rows)
    whole = pa.RecordBatch.from_pydict({"doc": pa.array([d for _, d in rows], pa.int64()), "mark": pa.array([m for m, _ in rows], pa.int64())})
    batches, at = [], 0
    for n in sizes * 40:
        batches.append(whole.slice(at, n))
        at += n
    got = [(r["mark"], r["doc"]) for b in bwt._of_two(iter(batches)) for r in b.to_pylist()]
    assert got == [r for r in rows if len({d for m, d in rows if m == r[0]}) > 1]
