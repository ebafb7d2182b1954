import numpy as np
import pyarrow as pa

from usagelens.llm import text as tx


def test_chunks_hold_whole_texts():
    texts = ["a" * 10, None, "", "é" * 40, "b"]
    got = []
    for first, raw, offs in tx.chunks(pa.chunked_array([texts[:2], texts[2:]], pa.string()), size=16):
        assert first == len(got)
        got += [raw[offs[i] : offs[i + 1]].tobytes().decode() for i in range(len(offs) - 1)]
    assert got == [t or "" for t in texts]


def test_chunks_of_a_slice():
    part = pa.array(["x", "yy", "zzz", "w"]).slice(1, 2)
    (only,) = list(tx.chunks(part))
    assert only[1].tobytes() == b"yyzzz" and only[2].tolist() == [0, 2, 5]


def test_words_do_not_cross_texts():
    texts = ["one two", "three", "", " ", "four  five "]
    _, raw, offs = next(tx.chunks(pa.array(texts)))
    starts, ends, owner = tx.word_spans(raw, offs, tx.NOT_SPACE)
    words = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert list(zip(words, owner.tolist(), strict=True)) == [("one", 0), ("two", 0), ("three", 1), ("four", 4), ("five", 4)]


def test_equal_words_have_equal_hashes_and_grams_stay_in_texts():
    texts = ["a b c a b c", "b c", "a b"]
    _, raw, offs = next(tx.chunks(pa.array(texts)))
    starts, ends, owner = tx.word_spans(raw, offs, tx.NOT_SPACE)
    h = tx.span_hashes(raw, starts, ends, tx.byte_values(1))
    assert len(set(h.tolist())) == 3 and h[0] == h[3] == h[8]
    g, at = tx.gram_hashes(h, owner, 2)
    assert at.tolist() == [0, 1, 2, 3, 4, 6, 8]
    assert g[1] == g[5] and g[0] == g[6] and len(set(g.tolist())) == 3


def test_no_words():
    _, raw, offs = next(tx.chunks(pa.array([""])))
    assert len(tx.word_spans(raw, offs, tx.NOT_SPACE)[0]) == 0
    assert len(tx.gram_hashes(np.zeros(0, np.uint64), np.zeros(0, int), 3)[0]) == 0
