"""Exact and approximate nearest neighbours by inner product, over packed blocks of vectors.

Candidates are packed where they are read into rows of many vectors; queries are packed into chunks alike. A unit of
work has a bounded number of queries and of candidates: a part with more is cut into slices and groups, each slice
meeting each group. A task reads a unit's queries first and then streams its candidates past them, so a packed row is
read once, and what a query has found so far raises the bar for the rows that follow. A query's best are merged from
its units.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import scratch, written

#: Vectors of a block, blocks of a packed row, and queries of a chunk.
BLOCK_VECTORS, ROW_BLOCKS, CHUNK_QUERIES = 256, 16, 256
#: Candidates and queries of a unit of work.
UNIT_CANDIDATES, UNIT_QUERIES = 1 << 14, 1 << 16
#: Entries that a unit holds before it cuts them to each query's best.
HELD_ENTRIES = 1 << 16
#: Vectors that a tree is fitted on at most, vectors of a leaf of the tree search, the share of true neighbours to find
#: in the sample, and leaves of the tree that orders the exact search's blocks.
SAMPLE_VECTORS, LEAF_VECTORS, SAMPLE_RECALL, ORDER_LEAVES = 20_000, 512, 0.94, 256
PACKED = "part int, ids binary, data binary"


def _vectors(b: pa.RecordBatch, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: no nulls, no non-finite components, one width."""
    ids, column = b.column(0), b.column(1).cast(pa.list_(pa.float64()))
    rows = [(i, x) for i, x in zip(ids.to_pylist(), column.to_pylist(), strict=True) if i is not None and x and None not in x and (width is None or len(x) == width)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, width or 0))
    x = np.array([x for _, x in rows])
    ok = np.isfinite(x).all(1)
    return np.array([i for i, _ in rows], np.int64)[ok], x[ok]


def _width(vectors: DataFrame) -> int:
    """The most frequent width, the larger one where two tie; a vector of another width has no product with the rest and takes no part."""
    row = vectors.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    return row[0]["k"] if row else 0


def _usable(vectors: DataFrame, width: int) -> DataFrame:
    """The rows of ``vectors(id, v)`` that take part."""
    return vectors.where(f"id IS NOT NULL AND size(v) = {width} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def _sample(usable: DataFrame, width: int) -> np.ndarray:
    """At most ``SAMPLE_VECTORS`` vectors, chosen by a hash of their id; an id once, so that a query meets itself at most once."""
    table = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VECTORS).toArrow()
    pieces = [_vectors(b, width) for b in table.to_batches()]
    if not pieces:
        return np.zeros((0, width))
    ids, sample = (np.concatenate(z) for z in zip(*pieces, strict=True))
    return sample[np.unique(ids, return_index=True)[1]]


def packed(
    vectors: DataFrame,
    width: int,
    rows: int,
    number: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None,
    prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x,
    rank: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``vectors(id, v)`` in rows of up to ``rows`` vectors, in order of ``rank``, if given, and id.

    ``number`` gives row numbers and parts of vectors, a vector in one part or several; a packed row is of one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, pieces in sorted(held.items()):
                ids, x = (np.concatenate(z) for z in zip(*pieces, strict=True))
                order = np.lexsort((ids, rank(x))) if rank else np.argsort(ids, kind="stable")
                for at in range(0, len(ids), rows):
                    o = order[at : at + rows]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids[o].tobytes()]), pa.array([x[o].tobytes()])], ["part", "ids", "data"])
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                ids, x = _vectors(b.slice(at, 2048), width)
                x = prepare(x)
                own, parts = number(x) if number and len(ids) else (np.arange(len(ids)), np.zeros(len(ids), np.int64))
                order = np.argsort(parts, kind="stable")
                own, parts = own[order], parts[order]
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
                for c, d in zip(cuts, cuts[1:], strict=False):
                    held.setdefault(int(parts[c]), []).append((ids[own[c:d]], x[own[c:d]]))
                count += len(own)
                if count >= 1 << 16:
                    yield from flush()
                    count = 0
        yield from flush()

    return vectors.mapInArrow(run, PACKED)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows, ranked from 1; ties go to the smaller vec_id. A task cuts its own rows to ``k`` a query before it sends them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x), still as doubles: whole numbers."""
    return np.floor(1024 * x)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows: by doubles while every partial sum is below 2**53, else by Python integers, held to 64 bits."""
    top = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    rows, columns = ([[int(v) for v in r] for r in m] for m in (a, b))
    clip = lambda v: max(-(2**63), min(2**63 - 1, v))
    return np.array([[clip(sum(u * v for u, v in zip(r, c, strict=True))) for c in columns] for r in rows], np.int64).reshape(len(a), len(b))


class _Best:
    """The best of a unit's candidates for each of its queries.

    A query comes with a score that ``k`` candidates reach, or none; entries below its bar are dropped, and the bar
    rises to the k-th best of what was found. Exact searches go block by block: a component's largest and smallest value
    in a block bound what the component can add, their sum over the components bounds the block, and a query looks at
    the blocks of a row in order of their bounds until they fall below its bar; equal bounds are still looked at.
    """

    def __init__(self, k: int, exact: bool):
        self.k, self.exact, self.chunks, self.entries, self.count = k, exact, [], [], 0
        self.asked, self.pairs, self.scored = False, 0, 0  # pairs of a query and a block: all, and those that were scored

    def ask(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Queries; the last column is the bar they come with."""
        self.chunks.append((ids, rows))
        self.asked = True

    def ready(self) -> None:
        self.ids, rows = (np.concatenate(x) for x in zip(*self.chunks, strict=True))
        self.queries = rows[:, :-1]
        self.bar = self._lowered(rows[:, -1])
        self.above, self.below = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        self.chunks.clear()

    @staticmethod
    def _lowered(scores: np.ndarray) -> np.ndarray:
        """A little less, since doubles may round."""
        return scores - 1e-9 * np.maximum(1.0, np.where(np.isfinite(scores), np.abs(scores), 0))

    def look(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self.chunks:
            self.ready()
        blocks = [slice(a, a + BLOCK_VECTORS) for a in range(0, len(ids), BLOCK_VECTORS)] if self.exact else [slice(0, len(ids))]
        self.pairs += len(blocks) * len(self.ids)
        if not self.exact:
            self._score(np.arange(len(self.ids)), ids, x)
            return
        bounds = self.above @ np.stack([x[b].max(0) for b in blocks]).T + self.below @ np.stack([x[b].min(0) for b in blocks]).T
        bounds += np.abs(bounds) * 1e-9
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(self.ids))
        for step in range(len(blocks)):
            nth = order[active, step]
            active = active[bounds[active, nth] >= self.bar[active]]
            if not len(active):
                break
            nth = order[active, step]
            for block in np.unique(nth):
                self._score(active[nth == block], ids[blocks[block]], x[blocks[block]])
            self._cut()

    def _score(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.scored += len(own)
        products = _products(self.queries[own], x) if self.exact else self.queries[own] @ x.T
        q, c = np.nonzero(products >= self.bar[own][:, None])
        other = ids[c] != self.ids[own[q]]  # however many rows the query has here, none of them takes a candidate's place
        q, c = q[other], c[other]
        if self.exact:
            score = products[q, c]
        else:
            score = np.empty(len(q))
            for at in range(0, len(q), 1 << 15):
                part = slice(at, at + (1 << 15))
                score[part] = (x[c[part]] * self.queries[own[q[part]]]).sum(1)  # one order of summing, wherever a vector stands: equal vectors tie
        self.entries.append((own[q], ids[c], score))
        self.count += len(q)
        if self.count > HELD_ENTRIES:
            self._cut()

    def _cut(self) -> None:
        """Keeps each query's ``k`` best and raises the bars."""
        if not self.entries:
            return
        q, ids, score = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        full = place == self.k - 1
        self.bar[q[full]] = np.maximum(self.bar[q[full]], self._lowered(score[full].astype(float)))
        self.entries = [(q[top], ids[top], score[top])]
        self.count = int(top.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        if not self.entries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if self.exact else float)
        q, ids, score = self.entries[0]
        return self.ids[q], ids, score


def _with_bar(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Queries with a score that ``k`` other vectors of the sample reach: one more, since the query may be among them."""
    bar = np.full(len(queries), -np.inf)
    if len(sample) > k:
        for at in range(0, len(queries), 256):
            bar[at : at + 256] = np.partition(queries[at : at + 256] @ sample.T, -k - 1, axis=1)[:, -k - 1]
    return np.column_stack([queries, bar])


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best for each row of ``vectors(vec_id, embedding)`` whose id ``every`` divides.

    Scores are inner products of floor(1024 * component), in whole numbers, held to 64 bits. A query's own id is no
    candidate. Fewer candidates than ``k`` all appear. Rows with a null id, a null, empty or odd-width vector, or null or
    non-finite components take no part; a repeated row is as many candidates, but an id is one query, the least of its
    vectors. An empty table gives no rows.

    Blocks hold vectors that a k-means tree over a bounded sample finds alike, so that clustered vectors have tight
    bounds; the sample also gives each query its first bar. Both decide the work only, never the result.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    width = _width(named)
    usable = _usable(named, width)
    sample = scaled(_sample(usable, width))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tree = MeansTree(sample, max(16, len(sample) // ORDER_LEAVES))
    shared = spark.sparkContext.broadcast((tree, sample))  # SAMPLE_VECTORS vectors at most
    candidates = packed(usable, width, BLOCK_VECTORS * ROW_BLOCKS, prepare=scaled, rank=lambda x: shared.value[0].home(x))
    asked = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = packed(asked, width, CHUNK_QUERIES, prepare=lambda x: _with_bar(scaled(x), shared.value[1], k))
    with scratch(spark) as held:
        return _best(written(_searched(held(candidates), held(queries), width, k, "long")), k)


def _searched(candidates: DataFrame, queries: DataFrame, width: int, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the best of every unit. Both sides are tables of packed rows, queries with their bar.

    The parts, leaves of a tree or a single one, are a bounded number, and so are the rows that say how to cut them.
    """
    count = lambda df, name: df.groupBy("part").agg(F.sum(F.octet_length("ids").cast("long") / 8).alias(name))
    sizes = count(candidates, "c").join(count(queries, "q"), "part")
    cuts = F.broadcast(sizes.select("part", F.ceil(F.col("c") / UNIT_CANDIDATES).alias("slices"), F.ceil(F.col("q") / UNIT_QUERIES).alias("groups")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("ids"), F.col(n))
    asked = queries.join(cuts, "part").select("part", each("slices").alias("piece"), own("groups").alias("bunch"), F.lit(0).alias("kind"), "ids", "data")
    looked = candidates.join(cuts, "part").select("part", own("slices").alias("piece"), each("groups").alias("bunch"), F.lit(1).alias("kind"), "ids", "data")
    keys = ["part", "piece", "bunch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                for at in range(b.num_rows):
                    yield tuple(c[at].as_py() for c in b.columns)

        for _, unit in groupby(stream(), lambda r: r[:3]):
            best = _Best(k, kind == "long")
            for *_, order, ids, data in unit:
                names = np.frombuffer(ids, np.int64)
                if order == 0:
                    best.ask(names, np.frombuffer(data).reshape(len(names), width + 1))
                elif best.asked:
                    best.look(names, np.frombuffer(data).reshape(len(names), width))
            query, vec, score = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64() if kind == "long" else pa.float64())], ["query_id", "vec_id", "score"])

    return asked.unionByName(looked).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


class MeansTree:
    """Hierarchical k-means over a bounded sample: centres and children of nodes; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, leaf_size: int, branches: int = 8, seed: int = 0):
        self.random, self.branches, self.leaf_size = np.random.default_rng(seed), branches, leaf_size
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, sample.mean(0))

    def _grow(self, own: np.ndarray, centre: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        near = self._means(own) if len(own) > self.leaf_size else None
        if near is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(own[near == k], own[near == k].mean(0)) for k in np.unique(near)]
        return node

    def _means(self, own: np.ndarray) -> np.ndarray | None:
        """The nearest of ``branches`` centres for each vector; none if the vectors can't be told apart."""
        k = min(self.branches, max(2, -(-len(own) // self.leaf_size)))
        centres = own[self.random.choice(len(own), k, replace=False)]
        for _ in range(12):
            near = self._nearest(own, centres)
            centres = np.stack([own[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
        near = self._nearest(own, centres)
        return near if len(np.unique(near)) > 1 else None

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre at each level."""
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
            elif len(at):
                kids = self.children[node]
                near = self._nearest(x[at], np.stack([self.centres[c] for c in kids]))
                stack += [(c, at[near == j]) for j, c in enumerate(kids)]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of a query: a priority queue of nodes, the centre with the largest product first."""
        score = self._all @ q
        queue, out = [(-score[0], 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
            for c in self.children[node]:
                heapq.heappush(queue, (-score[c], c))
        return out

    def ready(self) -> MeansTree:
        self._all = np.stack(self.centres)
        return self

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
        """The fewest leaf visits that find the wanted share of true neighbours in the sample; all leaves if none do."""
        home = self.home(sample)
        asked = self.random.choice(len(sample), min(queries, len(sample)), replace=False)
        k = min(k, len(sample) - 1)
        if k < 1:
            return self.leaves
        found = np.zeros(self.leaves)
        for i in asked:
            s = sample @ sample[i]
            s[i] = -np.inf
            place = np.empty(self.leaves, np.int64)
            place[self.best_first(sample[i], self.leaves)] = np.arange(self.leaves)
            found += np.bincount(place[home[np.argpartition(-s, k - 1)[:k]]], minlength=self.leaves)
        reached = np.cumsum(found) / (k * len(asked))
        return min(self.leaves, int(np.searchsorted(reached, recall)) + 1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = SAMPLE_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest found for each row of ``vectors(vec_id, embedding)`` whose id ``every`` divides.

    Nearness is the inner product in doubles, on the vectors as given. The tree is fitted on at most ``SAMPLE_VECTORS``
    vectors, chosen by a hash of their id; every vector is in a leaf, and as many leaves are visited as the sample needs
    for ``recall``, more while a query's leaves could hold fewer than ``k`` of the sample's share. Rows with a null id, a
    null, empty, zero or odd-width vector, or null or non-finite components take no part; a repeated row is as many
    candidates, but an id is one query, the least of its vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where("v IS NOT NULL AND exists(v, x -> x <> 0)")
    width = _width(named)
    usable = _usable(named, width)
    n, sample = usable.count(), _sample(usable, width)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = MeansTree(sample, max(16, LEAF_VECTORS * len(sample) // max(n, 1))).ready()
    visits = max(tree.calibrate(sample, k, recall), min(tree.leaves, -(-4 * k * tree.leaves // max(1, n))))
    if n <= 4 * k:
        visits = tree.leaves
    shared = spark.sparkContext.broadcast((tree, sample, tree.home(sample)))  # a tree and SAMPLE_VECTORS vectors at most

    def home(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(x)), shared.value[0].home(x)

    def with_bar(x: np.ndarray) -> np.ndarray:
        """Queries with a score that at least ``k`` others in their leaves reach, by the sample's vectors there."""
        tree, known, leaf = shared.value
        bar = np.full(len(x), -np.inf)
        for i, q in enumerate(x):
            chosen = np.zeros(tree.leaves, bool)
            chosen[tree.best_first(q, visits)] = True
            s = known[chosen[leaf]] @ q
            if len(s) > k:
                bar[i] = np.partition(s, -k - 1)[-k - 1]  # one more, since the query may be among them
        return np.column_stack([x, bar])

    def visited(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [shared.value[0].best_first(q, visits) for q in x[:, :-1]]
        return np.repeat(np.arange(len(x)), [len(f) for f in found]), np.array([leaf for f in found for leaf in f], np.int64)

    candidates = packed(usable, width, BLOCK_VECTORS * ROW_BLOCKS, home)
    asked = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = packed(asked, width, CHUNK_QUERIES, visited, with_bar)
    with scratch(spark) as held:
        return _best(written(_searched(held(candidates), held(queries), width, k, "double")), k)
