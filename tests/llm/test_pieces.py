import random
import weakref

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import pieces as ps


@pytest.fixture(scope="module")
def model():
    return ps.load_pieces()


@pytest.fixture(scope="module")
def toy():
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *"abc", "▁", "ab", "bc", "▁a", "▁ab", "cab", "abc", "▁▁"]
    ids = {n.replace("▁", " "): i for i, n in enumerate(names) if i > 256}
    scores = [0.0] * 257 + [-3.0, -3.5, -4.0, -2.0, -4.1, -5.3, -3.9, -6.6, -8.8, -9.1, -3.2]
    return ps.Pieces(ids, scores, names, list(range(1, 257)), -20.0, 3)


def every(p, text):
    """All segmentations of a whole text with their scores."""
    body = " " + text

    def grow(at):
        if at == len(body):
            yield 0.0, ()
            return
        options = [(e, p.scores[p.ids[body[at:e]]], (p.ids[body[at:e]],)) for e in range(at + 1, min(len(body), at + p.longest) + 1) if body[at:e] in p.ids]
        if body[at] not in p.ids:
            raw = body[at].encode()
            options.append((at + 1, p.unknown * len(raw), tuple(p.byte_ids[b] for b in raw)))
        for e, s, i in options:
            for more, rest in grow(e):
                yield s + more, i + rest

    return sorted(grow(0), key=lambda x: -x[0])


@given(st.text("abc é\n", min_size=1, max_size=9), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_n_best_of_a_text_equal_enumeration(toy, text, n):
    best, several, sound = ps.encode(toy, text, n, ps.Memory(toy))
    assert sound
    want = every(toy, text)
    assert [round(s, 6) for s, _ in several] == [round(s, 6) for s, _ in want[:n]]
    known = {i: s for s, i in want}
    seen = set()
    for s, changes in several:
        ids = best.tolist()
        for first, dropped, new in sorted(changes, reverse=True):
            ids[first : first + dropped] = new
        assert abs(known[tuple(ids)] - s) < 1e-6
        assert ps.decode(toy, ids) == text
        seen.add(tuple(ids))
    assert len(seen) == len(several)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_round_trip(model, text):
    best, _, sound = ps.encode(model, text, 3, ps.Memory(model))
    assert sound and (ps.decode(model, best) if len(best) else "") == text


def test_round_trip_of_special_signs(model):
    for text in [" ", "  ", "a  b ", "▁", "▁ a", "<s>", "<0x41>", "\n\n", "𝄞é", "\x00", " \n "]:
        assert ps.decode(model, ps.encode(model, text, 2, ps.Memory(model))[0]) == text


def test_best_scores_beat_the_librarys_merges(model):
    """The best segmentation scores at least as high as that of merges in order, which is one of the lattice."""
    from sentencepiece import SentencePieceProcessor

    merges = SentencePieceProcessor(model_file=ps.MODEL)
    for text in ["the quick brown fox", "internationalisation of words"]:
        _, several, _ = ps.encode(model, text, 1, ps.Memory(model))
        assert several[0][0] >= sum(model.scores[i] for i in merges.encode(text)) - 1e-6


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(ps, "REMEMBERED", 3)
    memory = ps.Memory(model)
    text = " ".join(f"w{i % 17}" for i in range(50))
    best, several, sound = ps.encode(model, text, 2, memory)
    assert len(memory.new) <= 3 and len(memory.old) <= 3 and sound
    monkeypatch.undo()
    again = ps.encode(model, text, 2, ps.Memory(model))
    assert (again[0].tolist(), again[1]) == (best.tolist(), several)


def test_documents(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    rows = ps.encode_documents(docs).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) and 1 <= len(r.alternatives) <= 4 for r in rows)
    assert all(a.score >= b.score for r in rows for a, b in zip(r.alternatives, r.alternatives[1:]))
    assert {r.doc_id: r.text for r in rows} == {r.doc_id: r.text for r in docs.collect()}


def test_nulls_empty_repeats_clashes(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a b", 7), (3, "a b", 7), (None, "c", 8), (4, "long " * 30_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = {r.doc_id: r for r in ps.encode_documents(df).collect()}
    assert (got[1].ids, got[1].alternatives, got[1].round_trip) == (None, None, None)
    assert (got[2].ids, got[2].n_pieces, [a.score for a in got[2].alternatives], got[2].round_trip) == ([], 0, [0.0], True)
    assert got[3].round_trip and got[None].round_trip and got[4].round_trip
    assert ps.encode_documents(df).count() == 6
    assert ps.encode_documents(df.limit(0)).collect() == []


def test_segments_scored_together_equal_the_search():
    """Best segmentation, score and loss of the second, by arrays and by one pass each way, against the A-star search."""
    p = ps.load_pieces()
    rng = random.Random(11)
    segments = ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for alphabet in ("abe ", "the ", "$%&", "aé中▁", "x🙂y") for _ in range(60)]
    segments += [" the", "a", " ", "\n", " " * 40, "e" * 64]
    together = ps._scored(p, segments)
    assert len(together) > 150
    for x in segments:
        want = ps.n_best(p, x, 2)
        loss = want[0][0] - want[1][0] if len(want) > 1 else ps.NEVER
        for ids, score, lost in [ps.best_and_loss(p, x)] + ([together[x][:3]] if x in together else []):
            assert ids == want[0][1] and abs(score - want[0][0]) < 1e-9 and abs(lost - loss) < 1e-9 * max(1, abs(loss))
        assert x not in together or together[x][3] and ps.decode(p, together[x][0], first=False) == x


def test_texts_are_encoded_alike_whatever_is_known():
    p = ps.load_pieces()
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("etaoin", k=rng.randrange(1, 9))) for _ in range(50)) for _ in range(6)] + ["", "z" * 300, "\n\n a"]
    known, blank = ps.Memory(p), ps.Memory(p)
    for t in texts:
        cut = ps.segments_of(p, t)
        known.learn(cut)
        a, b = ps.encode(p, t, 4, known, cut), ps.encode(p, t, 4, blank)
        assert a[0].tolist() == b[0].tolist() and a[1] == b[1] and a[2] == b[2]


def test_what_a_worker_knows_goes_with_its_vocabulary():
    p = ps.Pieces({"a": 0, "b": 1, "ab": 2}, [-1.0, -1.5, -2.0], ["a", "b", "ab"], [], -20.0, 2)
    p.known = ps.Memory(p)
    p.known.look("ab")
    held = weakref.ref(p.known)
    del p
    assert held() is None


def test_remembered_ids_are_packed():
    p = ps.Pieces({"a": 0, "b": 1, "ab": 2}, [-1.0, -1.5, -2.0], ["a", "b", "ab"], [], -20.0, 2)
    memory = ps.Memory(p)
    memory.learn(["ab"])
    memory.look("ba")
    assert {x: len(ids) // ps.ID_BYTES for x, (ids, *_) in memory.new.items()} == {"ab": 1, "ba": 2}
    assert ps.encode(p, "", 2, memory)[0].tolist() == []


def test_rows_are_encoded_in_small_shares():
    """What a worker makes of a share is many times its texts, so a share is a million bytes at most, or one row."""
    import pyarrow as pa

    from usagelens.llm import pieces

    texts = ["a" * 300_000, None, "b" * 300_000, "c" * 300_000, "d" * 300_000, "e" * 3_000_000, "f"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    shares = [b.column("text").to_pylist() for b in pieces._shares(batch, "text")]
    assert [x for s in shares for x in s] == texts
    assert all(len(s) == 1 or sum(len(x or "") for x in s) <= 1_000_000 for s in shares)
