import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import gear
from usagelens.llm.catalog import QUERIES


def slow_cuts(b):
    """Byte by byte, with a hash that is never reset."""
    out, last, h = [], 0, 0
    for i, c in enumerate(b):
        h = ((h << 1) + int(gear._GEAR[c])) & (2**64 - 1)
        # The hash of the last 32 bytes only differs above the looked-at bits.
        if i + 1 - last >= gear.SHORTEST and ((h >> (32 - gear.MEAN_BITS)) & ((1 << gear.MEAN_BITS) - 1)) == 0 or i + 1 - last == gear.LONGEST:
            out.append(i + 1)
            last = i + 1
    if last < len(b):
        out.append(len(b))
    return out


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_cuts_equal_the_plain_loop(b):
    assert gear.cuts(np.frombuffer(b, np.uint8)).tolist() == slow_cuts(b)


def test_an_insertion_moves_few_chunks():
    rng = random.Random(1)
    a = bytes(rng.randrange(97, 123) for _ in range(20_000))
    chunks = lambda b: {b[x:y] for x, y in zip([0, *gear.cuts(np.frombuffer(b, np.uint8))], gear.cuts(np.frombuffer(b, np.uint8)))}
    left, right = chunks(a), chunks(a[:7000] + b"inserted" + a[7000:])
    assert len(left - right) <= 6 and len(left) > 200


def brute(docs):
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        kept, at, n = b"", 0, 0
        for e in slow_cuts(b):
            c = b[at:e]
            if len(c) >= gear.SHORTEST and first.setdefault(c, (d, at)) != (d, at):
                n += 1
            else:
                kept += c
            at = e
        out[d] = (len(b), n, kept)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [say(400), say(900)]
    docs = [(i, "".join(rng.choice([say(rng.randrange(300)), rng.choice(passages)]) for _ in range(5))) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "y" * 5000), (53, docs[0][1]), (54, docs[0][1])]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, size int, d1 int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed_chunks, bytes(r.kept)) for r in gear.chunk_dedup(df).collect()}
    assert got == brute(docs)
    holders = [d for d, t in docs[:30] if passages[1] in t]
    assert all(got[d][1] > 0 for d in holders[1:])


def test_null_keys_repeats_and_empty(spark):
    t = "".join(random.Random(4).choices("abcdef", k=500))
    rows = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = gear.chunk_dedup(rows).collect()
    assert sorted((str(r.doc_id), len(r.kept) > 400) for r in got) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert gear.chunk_dedup(rows.limit(0)).collect() == []


def brute_ends(docs):
    """As brute, and a short end goes if it stood as an end before, after the same chunk."""
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        kept, at, n, before = b"", 0, 0, None
        for e in slow_cuts(b):
            c = b[at:e]
            mark = c if len(c) >= gear.SHORTEST else (before, c)
            if first.setdefault(mark, (d, at)) != (d, at):
                n += 1
            else:
                kept += c
            at, before = e, c
        out[d] = (len(b), n, kept)
    return out


def test_copies_and_copied_endings_go_whole(spark):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    end = say(500)
    docs = [(i, say(rng.randrange(600))) for i in range(40)]
    docs += [(100 + i, t) for i, t in docs]
    docs += [(200 + i, say(300) + end) for i in range(5)]
    docs += [(300, "five short words"), (301, "five short words"), (302, "five short words"), (303, "other words"), (304, None), (305, "")]
    docs += [(400 + i, say(300) + " The end.") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in gear.chunk_dedup(df, ends=True).collect()}
    assert {d: (r.n_bytes, r.n_removed_chunks, bytes(r.kept)) for d, r in rows.items()} == brute_ends(docs)
    assert all(rows[100 + i].n_removed == rows[100 + i].n_bytes for i in range(40))
    assert [rows[d].n_removed for d in (300, 301, 302, 303)] == [0, 16, 16, 0]
    assert all(not bytes(rows[d].kept).endswith(end[-8:].encode()) for d in range(201, 205))
    assert all(bytes(rows[400 + i].kept).endswith(b" The end.") for i in range(5))


def test_query_takes_exact_copies_whole(spark, tmp_path):
    t = "".join(random.Random(8).choices("abcdef", k=3000))
    texts = [t[:n] for n in range(900, 960)]
    spark.createDataFrame([(2 * i + j, x) for i, x in enumerate(texts) for j in (0, 1)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op3_gear_chunks"](spark, str(tmp_path)).collect()}
    assert all(got[2 * i + 1].n_removed == len(x) for i, x in enumerate(texts))
