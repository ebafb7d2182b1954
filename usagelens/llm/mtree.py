"""Exact top-k by inner product with M-trees: paged metric nodes searched best first."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.store import written

PAGE = 256
FANOUT = 16
#: Distances are rounded numbers; bounds are widened by this share before anything is left out.
SLACK = 1e-9


class Page:
    """A node: its routing object, covering radius, and entries with their distances to the routing object.

    Entries of an inner page are pages; those of a leaf are rows of the shard's matrix.
    """

    __slots__ = ("pivot", "radius", "to_pivot", "rows", "children")

    def __init__(self, pivot, radius, to_pivot, rows=None, children=None):
        self.pivot, self.radius, self.to_pivot, self.rows, self.children = pivot, radius, to_pivot, rows, children


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=-1).astype(float))


def build(x: np.ndarray, rows: np.ndarray | None = None, pivot: np.ndarray | None = None) -> Page:
    """Bulk load: entries go to the nearest of a page's routing objects until they fit a leaf page.

    ``x`` holds distinct vectors, so a split always parts them.
    """
    rows = np.arange(len(x)) if rows is None else rows
    pivot = x[rows[0]] if pivot is None else pivot
    own = _distances(x[rows], pivot)
    radius = float(own.max()) if len(rows) else 0.0
    if len(rows) <= PAGE:
        return Page(pivot, radius, own, rows=rows)
    # Routing objects spread by distance: each is the farthest from those before it in a stride of the entries; as many as fill the pages by half.
    fanout = min(FANOUT, max(2, -(-2 * len(rows) // PAGE)))
    pool = rows[:: max(1, len(rows) // (FANOUT * 16))]
    chosen = [int(pool[0])]
    far = _distances(x[pool], x[chosen[0]])
    while len(chosen) < fanout and far.max() > 0:
        chosen.append(int(pool[int(far.argmax())]))
        far = np.minimum(far, _distances(x[pool], x[chosen[-1]]))
    if len(chosen) == 1:
        chosen.append(int(rows[int(_distances(x[rows], x[chosen[0]]).argmax())]))
    nearest = np.argmin(np.stack([_distances(x[rows], x[c]) for c in chosen]), axis=0)
    children = [build(x, rows[nearest == i], x[c]) for i, c in enumerate(chosen) if (nearest == i).any()]
    return Page(pivot, radius, np.array([float(_distances(c.pivot, pivot)) for c in children]), children=children)


class Tree:
    """The pages of an M-tree as arrays, ready to be searched for many queries at once.

    Of each page: routing object, covering radius, largest norm, distance to the routing object of the page above, and its
    entries: the pages below, or rows of the shard's matrix in the order of their distance to the routing object.
    """

    def __init__(self, root: Page, x: np.ndarray, ids: list[np.ndarray]):
        pages, above, i = [root], [0.0], 0
        self.below: list[np.ndarray | None] = []
        while i < len(pages):
            page = pages[i]
            self.below.append(None if page.children is None else np.arange(len(pages), len(pages) + len(page.children)))
            if page.children is not None:
                pages += page.children
                above += page.to_pivot.tolist()
            i += 1
        self.pivots = np.stack([p.pivot for p in pages])
        self.radius = np.array([p.radius for p in pages])
        self.above = np.array(above)
        self.rows, self.distances = [], []
        for p in pages:
            order = np.argsort(p.to_pivot, kind="stable") if p.children is None else None
            self.rows.append(None if order is None else p.rows[order])
            self.distances.append(None if order is None else p.to_pivot[order])
        norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        self.norm = np.zeros(len(pages))
        for i in range(len(pages) - 1, -1, -1):
            self.norm[i] = norms[self.rows[i]].max(initial=0.0) if self.below[i] is None else self.norm[self.below[i]].max()
        self.x = x
        self.first = np.cumsum([0] + [len(i) for i in ids])
        self.ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in ids])


class Search:
    """The best ``k`` of a tree for a block of queries: best first for each, with the products of a page computed together.

    In a round each query opens its pages of highest bound, twice as many as in the round before, as long as their bound reaches
    its k-th score; so it opens at most about twice the pages that one at a time would.  A page is scored for all
    queries that open it in one matrix product.
    """

    def __init__(self, tree: Tree, q: np.ndarray, own: np.ndarray, k: int):
        # Doubles are exact for integers below 2^53; beyond it the products stay integers.
        exact = float(np.abs(tree.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2.0**53
        kind = np.float64 if exact else np.int64
        self.tree, self.k, self.own, self.exact = tree, k, own, exact
        self.q, self.x, self.pivots = q.astype(kind), tree.x.astype(kind, copy=False), tree.pivots.astype(kind)
        self.norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        self.pivot_norm = np.sqrt((tree.pivots.astype(float) ** 2).sum(axis=1))
        n = len(q)
        self.scores = np.zeros((n, k), dtype=kind)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.held = np.zeros(n, dtype=np.int64)
        self.least = np.full(n, -np.inf)
        self.bound = np.full((n, len(tree.below)), -np.inf)
        self.dot = np.zeros((n, len(tree.below)))
        self.computed = np.zeros(n, dtype=np.int64)

    def _away(self, some: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of queries to routing objects from their products: at most and at least the true ones."""
        square = self.norm[some, None] ** 2 + self.pivot_norm[pages] ** 2
        rest = square - 2 * self.dot[np.ix_(some, pages)]
        return tuple(np.sqrt(np.maximum(rest + e * square, 0)) for e in (-1e-12, 1e-12))

    def _reach(self, some: np.ndarray, dot: np.ndarray, span: np.ndarray, gap: np.ndarray, most: np.ndarray) -> np.ndarray:
        """No vector within ``span`` of a point of product ``dot``, ``gap`` or more from the query, of norm ``most`` or less scores higher.

        q.x is at most q.p + |q| span, at most |q| |x|, and equals (|q|^2 + |x|^2 - |q - x|^2) / 2.
        """
        norm = self.norm[some, None]
        best = np.minimum(np.minimum(dot + norm * span, norm * most), (norm**2 + most**2 - gap**2) / 2)
        return best + SLACK * (1 + norm * (most + span) + norm**2 + most**2)

    def _open(self, page: int, some: np.ndarray) -> None:
        some = some[self.bound[some, page] >= self.least[some]]
        self.bound[some, page] = -np.inf
        if not len(some):
            return
        if self.tree.below[page] is None:
            self._leaf(page, some)
        else:
            self._inner(page, some)

    def _inner(self, page: int, some: np.ndarray) -> None:
        """The pages below by their stored distance to this routing object, then by products with those that are left."""
        t, below = self.tree, self.tree.below[page]
        low, high = self._away(some, np.array([page]))
        gap = np.maximum(np.maximum(low - t.above[below], t.above[below] - high) - t.radius[below], 0)
        before = self._reach(some, self.dot[some, page][:, None], (t.above + t.radius)[below], gap, t.norm[below])
        wanted = before >= self.least[some, None]
        cols = wanted.any(axis=0)
        below, wanted, before = below[cols], wanted[:, cols], before[:, cols]
        if not len(below):
            return
        dot = (self.q[some] @ self.pivots[below].T).astype(float)
        self.computed[some] += len(below)
        self.dot[np.ix_(some, below)] = dot
        gap = np.maximum(self._away(some, below)[0] - t.radius[below], 0)
        self.bound[np.ix_(some, below)] = np.where(wanted, np.minimum(before, self._reach(some, dot, t.radius[below], gap, t.norm[below])), -np.inf)

    def _leaf(self, page: int, some: np.ndarray) -> None:
        """Entries are a run by distance to the routing object: nearer ones cannot score enough, farther ones are too far from the query."""
        t, distances, rows = self.tree, self.tree.distances[page], self.tree.rows[page]
        norm, least, most = self.norm[some], self.least[some], t.norm[page]
        slack = SLACK * (1 + norm * (most + t.radius[page]) + norm**2 + most**2)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = (least - slack - self.dot[some, page]) / norm
        low = np.where(norm > 0, low, -np.inf)
        width = np.sqrt(np.maximum(norm**2 + most**2 - 2 * (least - slack), 0))
        at_least, at_most = (d[:, 0] for d in self._away(some, np.array([page])))
        low, high = np.maximum(low, at_least - width), at_most + width
        begin = np.searchsorted(distances, low - np.abs(low) * SLACK - SLACK, "left")
        end = np.searchsorted(distances, high * (1 + SLACK) + SLACK, "right")
        ok = begin < end
        if ok.any():
            some, rows = some[ok], rows[int(begin[ok].min()) : int(end[ok].max())]
            self.computed[some] += len(rows)
            self._keep(some, rows, self.q[some] @ self.x[rows].T)

    def _keep(self, some: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        i, j = np.nonzero(scores >= self.least[some, None])
        if not len(i):
            return
        t, row = self.tree, rows[j]
        n = t.first[row + 1] - t.first[row]
        at = np.repeat(t.first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, score, key = np.repeat(some[i], n), np.repeat(scores[i, j], n), t.ids[at]
        other = key != self.own[who]
        touched = np.unique(some[i])
        have = self.held[touched]
        old = np.arange(self.k) < have[:, None]
        who = np.concatenate([who[other], np.repeat(touched, have)])
        score = np.concatenate([score[other], self.scores[touched][old]])
        key = np.concatenate([key[other], self.found[touched][old]])
        order = np.lexsort((key, -score, who))
        who, score, key = who[order], score[order], key[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        top = rank < self.k
        self.scores[who[top], rank[top]], self.found[who[top], rank[top]] = score[top], key[top]
        self.held[touched] = np.minimum(np.bincount(who, minlength=len(self.q))[touched], self.k)
        full = touched[self.held[touched] == self.k]
        least = self.scores[full, -1].astype(float)
        self.least[full] = least if self.exact else np.nextafter(least, -np.inf)

    def run(self) -> None:
        everyone = np.arange(len(self.q))
        self.dot[:, 0] = (self.q @ self.pivots[0]).astype(float)
        self.computed += 1
        self.bound[:, 0] = np.inf
        take, n_pages = 1, len(self.tree.below)
        while len(everyone):
            at = np.argpartition(-self.bound[everyone], take - 1, axis=1)[:, :take] if take < n_pages else np.broadcast_to(np.arange(n_pages), (len(everyone), n_pages))
            good = self.bound[everyone[:, None], at] >= np.maximum(self.least[everyone, None], -np.finfo(float).max)
            who, page = np.broadcast_to(everyone[:, None], at.shape)[good], at[good]
            order = np.argsort(page, kind="stable")
            pages, begins = np.unique(page[order], return_index=True)
            for p, some in zip(pages.tolist(), np.split(who[order], begins[1:]), strict=True) if len(pages) else ():
                self._open(p, some)
            left = (self.bound[everyone] >= np.maximum(self.least[everyone, None], -np.finfo(float).max)).any(axis=1)
            everyone, take = everyone[left], min(2 * take, n_pages)


def search_block(tree: Tree, q: np.ndarray, own: np.ndarray, k: int, together: int = 1024) -> pd.DataFrame:
    """(query, id, score, computed): the best ``k`` of each row of ``q`` other than the id ``own`` of it, ties to the smaller id.

    ``computed`` is how many products with routing objects and entries the search of that query took part in.  Queries are
    searched ``together`` at a time, which bounds the memory for their bounds.
    """
    out = []
    for a in range(0, len(q), together):
        part = Search(tree, q[a : a + together], own[a : a + together], k)
        part.run()
        i, j = np.nonzero(np.arange(k) < part.held[:, None])
        out.append(pd.DataFrame({"query": a + i, "id": part.found[i, j], "score": part.scores[i, j].astype(np.int64), "computed": part.computed[i]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query", "id", "score", "computed")})


def search(root: Page, x: np.ndarray, ids: list[np.ndarray], q: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """The best ``k`` (score, id) of one query, and how many products were computed."""
    found = search_block(Tree(root, x, ids), q[None], np.array([own]), k)
    return list(zip(found.score.tolist(), found.id.tolist(), strict=True)), int(found.computed.max()) if len(found) else 0


def quantised(vector: str) -> Column:
    """floor(256 x) of each component as double; null where the vector is null or holds null, NaN or infinity."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(x * 256)))


def build_index(vectors: DataFrame, key: str, vector: str, k: int, rows_per_shard: int = 16384) -> tuple[DataFrame, int]:
    """(shard, tree) and the number of shards: an M-tree over each shard of the distinct vectors, written to the shared folder.

    Rows of one vector are reduced to the ``k + 1`` smallest keys, before the shuffle: no further row of it
    can be among a query's best ``k``.  So a vector that a third of all rows hold is one entry.  Shards are dealt
    by a hash of the vector and hold about ``rows_per_shard`` entries, which bounds a task's memory.
    """
    rows = vectors.select(F.col(key).alias("id"), quantised(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).distinct()
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    entries = written(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    n_shards = max(1, -(-entries.count() // rows_per_shard))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        x = _matrix(pdf.v)
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "tree": [pickle.dumps(Tree(build(x), x, [np.asarray(i) for i in pdf.ids]))]})

    dealt = entries.withColumn("h", F.xxhash64("v")).withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(plant, "shard int, tree binary"), "mtree"), n_shards


def _matrix(vs: pd.Series) -> np.ndarray:
    sizes = {len(v) for v in vs}
    if len(sizes) == 1:
        return np.stack(vs.to_list()).astype(np.int64)
    x = np.zeros((len(vs), max(sizes, default=0)), dtype=np.int64)
    for i, v in enumerate(vs):
        x[i, : len(v)] = v
    return x


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, block: int = 16384, rows_per_shard: int = 16384) -> DataFrame:
    """(query_id, rank, key, score, computed): each query's ``k`` highest integer inner products over all other rows.

    Queries come in blocks; each block meets each shard's tree once, in a task of its own, and leaves ``k`` rows a query;
    the best of those are the result.  Exact, ties to the smaller key; fewer rows if there are fewer.
    ``computed`` counts the products that the query's search of the shard took part in.  A tree is copied once for each block
    and a query once for each shard: with blocks as large as shards, neither outweighs the other.

    Vectors that are null or hold null or non-finite components, and null keys, take no part on either
    side; repeated rows count once; missing components of shorter vectors count as 0; an empty table gives
    an empty result; other columns take no part.  Scores must fit a long.
    """
    index, n_shards = build_index(vectors, key, vector, k, rows_per_shard)
    asked = queries.select(F.col(key).alias("id"), quantised(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).distinct()
    n_blocks = max(1, -(-asked.count() // block))
    # Every block of the stated query set goes to every shard: the number of shards and blocks, not of rows, is multiplied.
    numbers = F.sequence(F.lit(0), F.lit(n_shards - 1))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(numbers))
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", key, "score", "computed")})
        tree = pickle.loads(right.tree.iloc[0])
        own, d = left.id.to_numpy(), tree.x.shape[1]
        q = _matrix(left.v)
        q = np.pad(q[:, :d], ((0, 0), (0, max(0, d - q.shape[1]))))
        found = search_block(tree, q, own, k)
        return pd.DataFrame({"query_id": own[found["query"]], key: found["id"], "score": found["score"], "computed": found["computed"]})

    near = sent.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInPandas(find, f"query_id long, `{key}` long, score long, computed long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", key, "score", "computed")
