"""N-best segmentation of texts into the pieces of a given vocabulary, and back."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import chain
from math import fsum
from weakref import ref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that a worker remembers as lately used; as many from before that are kept beside them.
REMEMBERED = 400_000
LOST = -1e18
#: Segments of up to so many characters are scored together, in arrays for so many of them at a time; longer ones alone.
TOGETHER, AT_ONCE = 64, 5_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Pieces with their ids and scores, and the ids of single bytes for what no piece covers.

    Pieces are kept with plain spaces in place of the space sign, so a literal space sign of a text is a
    character without a piece, and comes back from its bytes.
    """

    ids: dict[str, int]
    scores: list[float]
    names: list[str]
    byte_ids: list[int]
    unknown: float
    longest: int
    cut: str = field(default="")

    def __post_init__(self):
        #: What a worker has learned with this vocabulary; it goes with it.
        self.known: Memory | None = None
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.plain = [n.replace(SPACE, " ") for n in self.names]
        #: The text of every piece but single bytes, which say something only together.
        self.texts = [None if i in self.byte_of else n for i, n in enumerate(self.plain)]
        #: Beginnings of pieces: the id of the piece, or -1 if only longer pieces begin so.
        self.begins = {n[:j]: -1 for n in self.ids for j in range(1, len(n))} | self.ids
        #: The same by hash, sorted, for many at once.
        hashes = np.zeros(len(self.begins), np.uint64)
        for at, name in enumerate(self.begins):
            h = 0
            for c in name:
                h = (h * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
            hashes[at] = h
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.begins.values()), np.int64)[order]
        self.values = np.array(self.scores)
        # Texts fall apart where a space follows something else, as no piece spans that, and around line ends without a piece.
        spans = any(re.search("[^ ] ", p) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        self.cut = self.cut or (r"(?s).+" if spans else " *[^ ]+| +" if lines else "\n| *[^ \n]+| +")


def load_pieces(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file; only ordinary pieces and single bytes are used."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    scores = [model.get_score(i) for i in range(n)]
    byte_ids = [-1] * 256
    ids = {}
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[name.replace(SPACE, " ")] = i
    usual = [scores[i] for i in ids.values() if scores[i] > -1e8]
    return Pieces(ids, scores, names, byte_ids, min(usual) - 10, max(map(len, ids)))


def n_best(p: Pieces, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations, best first.

    Forward, the best score of every prefix is found (Viterbi).  Backward, an A-star search grows suffixes
    from the end; the prefix scores are the exact rest of each, so no suffix is grown that is not part of one
    of the next best results.  A character without a piece becomes its bytes.
    """
    size = len(segment)
    forward = [LOST] * (size + 1)
    forward[0] = 0.0
    arcs: list[list] = [[] for _ in range(size + 1)]
    begins, scores = p.begins, p.scores
    for start in range(size):
        base = forward[start]
        if base == LOST:
            continue
        single = False
        for end in range(start + 1, size + 1):
            i = begins.get(segment[start:end])
            if i is None:
                break
            if i >= 0:
                single = single or end == start + 1
                s = scores[i]
                arcs[end].append((start, s, i))
                if base + s > forward[end]:
                    forward[end] = base + s
        if not single:
            raw = segment[start].encode()
            s = p.unknown * len(raw)
            arcs[start + 1].append((start, s, tuple(p.byte_ids[b] for b in raw)))
            if base + s > forward[start + 1]:
                forward[start + 1] = base + s
    order = 0
    queue = [(-forward[size], 0, size, 0.0, None)]
    out = []
    while queue:
        _, _, at, tail, path = heappop(queue)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                i, path = path
                ids.append(i) if isinstance(i, int) else ids.extend(i)
            out.append((tail, tuple(ids)))
            if len(out) == n:
                break
            continue
        for start, s, i in arcs[at]:
            order += 1
            heappush(queue, (-(forward[start] + s + tail), order, start, tail + s, (i, path)))
    return out


def best_and_loss(p: Pieces, segment: str) -> tuple[tuple[int, ...], float, float]:
    """The first of :func:`n_best` with its score, and how much less the second scores; without a search.

    Scores of prefixes and of suffixes are found by one pass each way.  The second best leaves the best path by some arc, and the
    best path through an arc has the score of its prefix, its own, and that of its suffix.  Where two paths are as good as
    equal, the search decides which is first.
    """
    size = len(segment)
    forward = [LOST] * (size + 1)
    forward[0] = 0.0
    came: list = [None] * (size + 1)
    arcs = []
    find, scores = p.begins.get, p.scores
    for start in range(size):
        base = forward[start]
        if base == LOST:
            continue
        single = False
        for end in range(start + 1, size + 1):
            i = find(segment[start:end])
            if i is None:
                break
            if i >= 0:
                if end == start + 1:
                    single = True
                s = scores[i]
                arcs.append((start, end, s))
                if base + s > forward[end]:
                    forward[end] = base + s
                    came[end] = (start, i)
        if not single:
            raw = segment[start].encode()
            s = p.unknown * len(raw)
            arcs.append((start, start + 1, s))
            if base + s > forward[start + 1]:
                forward[start + 1] = base + s
                came[start + 1] = (start, tuple(p.byte_ids[b] for b in raw))
    path, before, at = [], {}, size
    while at:
        start, i = came[at]
        before[at] = start
        path.append(i)
        at = start
    backward = [LOST] * (size + 1)
    backward[size] = 0.0
    second = LOST
    on_path = before.get
    for start, end, s in reversed(arcs):
        rest = s + backward[end]
        if rest > backward[start]:
            backward[start] = rest
        rest += forward[start]
        if rest > second and on_path(end) != start:
            second = rest
    best = forward[size]
    loss = best - second if second > LOST / 2 else NEVER
    if loss < TIE:
        results = n_best(p, segment, 2)
        return results[0][1], results[0][0], results[0][0] - results[1][0]
    ids: list[int] = []
    for i in reversed(path):
        ids.append(i) if isinstance(i, int) else ids.extend(i)
    return tuple(ids), best, loss


def _arcs(p: Pieces, code: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, score, id) of all pieces in the characters, by their first place; ``room`` is how far each place's segment goes on.

    Pieces are found by the hashes of their beginnings.  A character without a piece has an arc of id -1.
    """
    at = np.arange(len(code))
    h = np.zeros(len(code), np.uint64)
    found = []
    bare = np.ones(len(code), bool)
    size = 0
    while len(at):
        size += 1
        h = h * _STEP + code[at + size - 1] + np.uint64(1)
        place = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
        alive = p.hashes[place] == h
        at, h, ids = at[alive], h[alive], p.hash_ids[place[alive]]
        full = ids >= 0
        if size == 1:
            bare[at[full]] = False
        found.append((at[full], np.full(full.sum(), size), ids[full]))
        more = room[at] > size
        at, h = at[more], h[more]
    none = np.flatnonzero(bare)
    found.append((none, np.ones(len(none), np.int64), np.full(len(none), -1)))
    first, length, ids = (np.concatenate([f[j] for f in found]) for j in range(3))
    order = np.lexsort((length, first))
    first, length, ids = first[order], length[order], ids[order]
    lost = code[first]
    n_bytes = 1 + (lost > 0x7F).astype(np.int64) + (lost > 0x7FF) + (lost > 0xFFFF)
    return first, first + length, np.where(ids >= 0, p.values[ids], p.unknown * n_bytes), ids


#: Ids that are remembered are the bytes of 32-bit numbers, so that those of a text are joined at once.
ID_BYTES = 4


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


def _scored(p: Pieces, segments: list[str], packed: bool = False) -> dict[str, tuple[tuple[int, ...] | bytes, float, float, bool]]:
    """What Memory.look() says of each segment, ids as such unless ``packed``: best_and_loss() for all of them at once, place by place."""
    if not segments:
        return {}
    code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in segments])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    segment = np.repeat(np.arange(len(segments)), sizes)
    first, end, score, ids = _arcs(p, code, begin[1:][segment] - np.arange(len(code)))
    of = segment[first]
    # A place of its own for the end of each segment: place i of segment s is i + s.
    tail, head = first + of, end + of
    depth = first - begin[of]
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(sizes.max() + 1))
    steps = [by_depth[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    forward, came = np.full(len(code) + len(segments), LOST), np.full(len(code) + len(segments), -1)
    forward[begin[:-1] + np.arange(len(segments))] = 0.0
    for arcs in steps:  # arcs that begin at one place of each segment end at different places
        reach = forward[tail[arcs]] + score[arcs]
        better = reach > forward[head[arcs]]
        arcs = arcs[better]
        forward[head[arcs]], came[head[arcs]] = reach[better], arcs
    backward = np.full(len(forward), LOST)
    last = begin[1:] + np.arange(len(segments))
    backward[last] = 0.0
    rest = np.empty(len(first))
    for arcs in reversed(steps):
        rest[arcs] = score[arcs] + backward[head[arcs]]
        runs = np.flatnonzero(np.diff(tail[arcs], prepend=-1))
        backward[tail[arcs][runs]] = np.maximum.reduceat(rest[arcs], runs)
    path = np.zeros(len(first), bool)
    at, done = last.copy(), begin[:-1] + np.arange(len(segments))
    while len(at):
        arcs = came[at]
        path[arcs] = True
        open_ = tail[arcs] != done
        at, done = tail[arcs][open_], done[open_]
    through = np.where(path, LOST, rest + forward[tail])
    second = np.maximum.reduceat(through, np.searchsorted(of, np.arange(len(segments))))
    best = forward[last]
    loss = np.where(second > LOST / 2, best - second, NEVER)
    chosen = ids[path]
    edges = np.searchsorted(of[path], np.arange(len(segments) + 1)).tolist()
    bare = np.zeros(len(segments), bool)
    bare[of[path & (ids < 0)]] = True
    out = {}
    raw = chosen.astype(np.int32).tobytes()
    chosen, texts = chosen.tolist(), p.texts
    for x, a, b, total, lost, alone in zip(segments, edges, edges[1:], best.tolist(), loss.tolist(), bare.tolist(), strict=False):
        own, kept = chosen[a:b], raw[ID_BYTES * a : ID_BYTES * b]
        if lost < TIE and not alone:
            (total, own), (other, _) = n_best(p, x, 2)
            lost, kept = total - other, _packed(own)
        # Single bytes, and a hash that spoke of another piece, are left to the plain way.
        if not alone and "".join([texts[i] or "" for i in own]) == x:
            out[x] = (kept if packed else tuple(own), total, lost, True)
    return out


class Memory:
    """What a worker knows of segments: ids (as bytes) and score of the best segmentation, loss of the next, does it decode.

    Bounded: when as many as ``remembered`` are new, those from before are forgotten unless they were used again.
    """

    def __init__(self, p: Pieces, remembered: int | None = None):
        self._p, self.new, self.old, self.several, self.remembered = ref(p), {}, {}, {}, REMEMBERED if remembered is None else remembered

    @property
    def p(self) -> Pieces:
        return self._p()

    def learn(self, segments: Iterable[str]) -> None:
        """Finds what look() says of segments that it does not know yet, many at a time."""
        fresh = [x for x in dict.fromkeys(segments) if x not in self.new]
        for at in range(0, len(fresh), AT_ONCE):
            some = []
            for x in fresh[at : at + AT_ONCE]:
                got = self.old.get(x)
                if got is not None:
                    self.new[x] = got
                elif len(x) <= TOGETHER:
                    some.append(x)
            if len(self.new) + len(some) > self.remembered:
                self.new, self.old = {}, self.new
            self.new.update(_scored(self.p, some, packed=True))

    def look(self, segment: str) -> tuple[bytes, float, float, bool]:
        got = self.old.get(segment)
        if got is None:
            ids, score, loss = best_and_loss(self.p, segment)
            texts = [self.p.texts[i] for i in ids]
            got = (_packed(ids), score, loss, "".join(texts) == segment if None not in texts else decode(self.p, ids, first=False) == segment)
        if len(self.new) >= self.remembered:
            self.new, self.old = {}, self.new
        self.new[segment] = got
        return got

    def best_few(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        got = self.several.get((segment, n))
        if got is None:
            if len(self.several) >= self.remembered // 10:
                self.several = {}
            got = self.several[segment, n] = n_best(self.p, segment, n)
        return got


NEVER = 1e300
#: Two scores that differ by less may be sums of the same numbers in another order.
TIE = 1e-6


def segments_of(p: Pieces, text: str | None) -> list[str]:
    """The independent segments of a text, which has a space put before it."""
    return re.findall(p.cut, " " + text) if text else []


def encode(p: Pieces, text: str, n: int, memory: Memory, segments: list[str] | None = None) -> tuple[np.ndarray, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]], bool]:
    """Ids of the best segmentation; for each of the ``n`` best its score and what differs from the best; does it decode.

    A difference is (first piece, pieces dropped, ids instead).  A text is a chain of independent segments, so its
    next best segmentations change the segments of least loss: only the n - 1 with the smallest first loss can
    be among them, and those are combined best first.  Decoding is the chain of the decoded segments.
    """
    segments = segments_of(p, text) if segments is None else segments
    look = memory.look
    found = [got or look(s) for got, s in zip(map(memory.new.get, segments), segments, strict=True)]
    packed, scores, lost, sounds = zip(*found, strict=True) if found else ((), (), (), ())
    best = np.frombuffer(b"".join(packed), np.int32)
    total = fsum(scores)
    losses = np.array(lost)
    sound = all(sounds) and (not text or "".join(segments) == " " + text)
    open_: list[int] = []
    if n > 1 and len(losses):
        limit = np.partition(losses, n - 2)[n - 2] if len(losses) >= n else np.inf
        near = np.flatnonzero(losses <= limit)
        open_ = sorted(near[np.argsort(losses[near], kind="stable")][: n - 1].tolist())
        open_ = [i for i in open_ if losses[i] < NEVER]
    few = [memory.best_few(segments[i], n) for i in open_]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // ID_BYTES
    ends = np.cumsum(sizes) if open_ else []
    # Combinations: (loss, choice of each open segment), grown from the last changed segment on.
    queue = [(0.0, (0,) * len(open_), 0)]
    out = []
    while queue and len(out) < n:
        loss, choice, last = heappop(queue)
        changes = [(int(ends[i] - sizes[i]), int(sizes[i]), r[c][1]) for i, r, c in zip(open_, few, choice, strict=True) if c]
        out.append((total - loss, changes))
        for j in range(last, len(open_)):
            c = choice[j] + 1
            if c < len(few[j]) and (j == last or not choice[j]):
                heappush(queue, (loss + few[j][c - 1][0] - few[j][c][0], choice[:j] + (c,) + choice[j + 1 :], j))
    return best, out, sound


def decode(p: Pieces, ids, first: bool = True) -> str:
    """The text of a segmentation; ``first``: without the space that is put before a text."""
    out, raw = [], bytearray()
    for i in ids:
        b = p.byte_of.get(i)
        if b is None:
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(p.plain[i])
        else:
            raw.append(b)
    out.append(raw.decode("utf-8", "replace"))
    return "".join(out)[1 if first else 0 :]


def _shares(batch: pa.RecordBatch, text: str):
    """Runs of at most 512 rows whose texts have at most a million bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == 512 or total + n > 1_000_000):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if sizes:
        yield batch.slice(first)


def encode_documents(docs: DataFrame, text: str = "text", n: int = 4, model: str = MODEL, ids: str = "ids", remembered: int | None = None) -> DataFrame:
    """Add to each row its segmentation into pieces, and check the way back.

    ``ids``: the best segmentation of the whole text; n_pieces; ``alternatives``: the n best as
    (score, n_pieces, changes against the best), the best first; round_trip: whether decoding gives the text
    again, byte for byte.  A worker remembers the segments it has seen, a bounded number; the vocabulary is
    broadcast, its size is that of the model file.

    Null gives null ids and no alternatives; an empty text has no pieces and one segmentation of score 0;
    texts with fewer than n segmentations give all they have; equal scores are ordered by the search, the same
    for equal texts; repeated rows are encoded alike; columns of the added names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    added = [ids, "n_pieces", "alternatives", "round_trip"]
    kept = [c for c in docs.columns if c not in added]
    change = "struct<first:int,dropped:int,ids:array<int>>"
    kinds = ["array<int>", "int", f"array<struct<score:double,n_pieces:int,changes:array<{change}>>>", "boolean"]
    new_fields = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in zip(added, kinds, strict=True)))
    schema = StructType([*docs.select(*kept).schema.fields, *new_fields.fields])
    a_change = pa.struct([("first", pa.int32()), ("dropped", pa.int32()), ("ids", pa.list_(pa.int32()))])
    a_best = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("changes", pa.list_(a_change))]))

    def encoded(batches):
        p = shared.value
        if p.known is None:
            p.known = Memory(p, remembered)
        # A worker keeps what it knows from task to task, until Spark takes the vocabulary from it for tasks without it.
        memory = p.known
        for whole in batches:
            for b in _shares(whole, text):
                bests, alternatives, sounds = [], [], []
                texts = b.column(text).to_pylist()
                cut = [segments_of(p, t) for t in texts]
                memory.learn(chain.from_iterable(cut))
                for t, segments in zip(texts, cut, strict=True):
                    if t is None:
                        bests.append(None)
                        alternatives.append(None)
                        sounds.append(None)
                        continue
                    best, several, sound = encode(p, t, n, memory, segments)
                    bests.append(best)
                    sounds.append(sound)
                    alternatives.append([
                        {"score": s, "n_pieces": len(best) + sum(len(i) - d for _, d, i in c), "changes": [{"first": f, "dropped": d, "ids": i} for f, d, i in c]}
                        for s, c in several
                    ])
                new = [
                    pa.array(bests, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in bests], pa.int32()),
                    pa.array(alternatives, a_best), pa.array(sounds, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], names=[*kept, *added])

    return docs.select(*kept).mapInArrow(encoded, schema)
