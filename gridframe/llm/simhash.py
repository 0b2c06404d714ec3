"""SimHash fingerprints and near-duplicates by a vantage-point tree over Hamming distance.

Equal fingerprints fold to one row first, so copies cost nothing further. A vantage-point tree, built from a bounded
sample, cuts the fingerprints into shards: a node sends what lies within its radius inside, the rest outside. Every
fingerprint lives in one shard and also visits, as a query, each shard that the triangle bound cannot rule out: with a
pair at most r apart, a query goes inside unless its distance exceeds the radius by more than r, and outside unless it
falls short by r or more. A pair lies across two shards or within one; its members meet in the shard of the smaller
number. Visits multiply with every level, so the tree has a few shards, whatever the input. Within a shard a pair at
most r apart agrees in one of r + 1 runs of bits, so fingerprints meet there by run and value: r + 1 rows a visit.
Each unit of work links what it has found to one root each, so a dense group leaves a star, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import scratch, slices, texts, written

#: Fingerprints that the tree is built from at most, that a shard should hold, and shards at most: each level takes its
#: share of visits, so their number bounds how often a fingerprint travels.
SAMPLE_FINGERPRINTS = 1 << 16
SHARD_FINGERPRINTS = 1024
MAX_SHARDS = 8
#: Residents that agree in a run of bits, and fingerprints compared with them, that one unit of work takes.
UNIT_RESIDENTS, UNIT_VISITORS = 2048, 16384
#: Rows of a unit up to which its pairs are found together with other units'.
SMALL_UNIT = 64
#: A shard of the tree has at least so many fingerprints of the sample.
MIN_SAMPLE = 8


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' hashes, repeats included; 0 without words. A-Z count as a-z."""
    tokens = text.encode().lower().split()  # bytes: only ASCII letters and ASCII white space
    if not tokens:
        return 0
    line, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return h(line, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes).tolist(), ends[words - 1 :].tolist()
    return majority(np.array([h(line[a:b], seed) for a, b in zip(begins, ends, strict=False)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: each bit as more than half of them have it; 0 without hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``; fp is the fingerprint as a signed long. Null texts: empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x, words) for x in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(run, "doc_id long, fp long")


class VantagePointTree:
    """Nodes as arrays: vantage point, radius and the two children; a child below zero is shard ``-1 - child``."""

    def __init__(self, sample: np.ndarray, shards: int, reach: int, seed: int = 0):
        self.reach, self.points, self.radii, self.children, self.shards = reach, [], [], [], 0
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), max(1, shards))

    def _grow(self, own: np.ndarray, shards: int) -> int:
        split = self._split(own) if shards > 1 and len(own) >= 2 * MIN_SAMPLE else None
        if split is None:
            self.shards += 1
            return -self.shards
        point, radius = split
        node = len(self.points)
        self.points.append(point)
        self.radii.append(radius)
        self.children.append((0, 0))
        inside = np.bitwise_count(own ^ point) <= radius
        left = max(1, round(shards * inside.mean()))
        self.children[node] = (self._grow(own[inside], left), self._grow(own[~inside], max(1, shards - left)))
        return node

    def _split(self, own: np.ndarray) -> tuple[np.uint64, int] | None:
        """Of a few vantage points and radii, the pair that sends the fewest fingerprints both ways, with a third on each side."""
        best = None
        for point in self.random.choice(own, min(16, len(own)), replace=False):
            d = np.bitwise_count(own ^ point).astype(np.int64)
            below = np.cumsum(np.bincount(d, minlength=65)) / len(d)
            for radius in range(64):
                if min(below[radius], 1 - below[radius]) >= 0.33:
                    both = below[min(64, radius + self.reach)] - (below[radius - self.reach] if radius >= self.reach else 0)
                    if best is None or both < best[0]:
                        best = both, point, radius
        return best and best[1:]

    def visits(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, shards and whether it is the home shard, for every shard that a fingerprint may have neighbours in."""
        rows, shards, homes = [], [], []
        stack = [(self.root, np.arange(len(fp)), np.ones(len(fp), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), -1 - node))
                homes.append(home)
                continue
            d, radius = np.bitwise_count(fp[at] ^ self.points[node]).astype(np.int64), self.radii[node]
            inside, outside = d - self.reach <= radius, d + self.reach > radius
            stack.append((self.children[node][0], at[inside], home[inside] & (d[inside] <= radius)))
            stack.append((self.children[node][1], at[outside], home[outside] & (d[outside] > radius)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        row, shard, home = np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)
        own = np.zeros(len(fp), np.int64)
        own[row[home]] = shard[home]
        keep = shard <= own[row]  # the pair's other member comes to the smaller shard
        return row[keep], shard[keep], home[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def runs(reach: int) -> list[tuple[int, np.uint64]]:
    """First bit and mask, once it is shifted to that bit, of ``reach`` + 1 runs of bits: what differs in ``reach`` bits agrees in a run."""
    ends = [64 * k // (reach + 1) for k in range(reach + 2)]
    return [(a, np.uint64((1 << (b - a)) - 1)) for a, b in pairwise(ends)]


def _meets_first(apart: np.ndarray, nth: np.ndarray, reach: int) -> np.ndarray:
    """Whether fingerprints that are ``apart`` agree in no run before the ``nth``, so that a pair counts in one run alone."""
    first = np.ones(len(apart), bool)
    for k, (shift, mask) in enumerate(runs(reach)[:-1]):
        first &= (nth <= k) | ((apart >> np.uint64(shift)) & mask != 0)
    return first


Unit = tuple[np.ndarray, ...]


def _pairs(unit: Unit, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (resident, visitor) of one unit that lie within ``reach``, some visitors at a time. Rows: nth run, fp, id, resident, visitor."""
    nth, fp, _, resident, visitor = unit
    first, others = np.flatnonzero(resident), np.flatnonzero(visitor)
    for at in range(0, len(others), 512):
        part = others[at : at + 512]
        apart = fp[first][:, None] ^ fp[part][None, :]
        x, y = np.nonzero(np.bitwise_count(apart) <= reach)
        apart, x, y = apart[x, y], first[x], part[y]
        keep = (x != y) & _meets_first(apart, nth[x], reach)
        yield x[keep], y[keep]


def _small_pairs(units: Unit, size: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small units of ``size`` rows in a row: each row meets those behind it in its unit, one step after the other."""
    nth, fp, _, resident, visitor = units
    left = np.repeat(np.cumsum(size), size) - np.arange(len(fp))  # rows up to the unit's end
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    x, step = np.arange(len(fp)), 0
    while step := step + 1:
        x = x[left[x] > step]
        if not len(x):
            break
        y = x + step
        apart = fp[x] ^ fp[y]
        near = np.flatnonzero(np.bitwise_count(apart) <= reach)
        near = near[_meets_first(apart[near], nth[x[near]], reach)]
        a, b = x[near], y[near]
        one, two = (resident[a] & visitor[b]), (resident[b] & visitor[a])
        found += [(a[one], b[one]), (b[two], a[two])]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _star(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row that pairs of rows link to its root, as ids."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.array(_roots(len(rows), at[: len(a)], at[len(a) :]), np.int64)
    moved = np.flatnonzero(root != np.arange(len(rows)))
    return ids[rows[moved]], ids[rows[root[moved]]]


def _drawn(fp: np.ndarray, x: np.ndarray, y: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (resident, visitor) of rows at most ``partners`` for each visitor, drawn by a hash of the two."""
    order = np.lexsort(((fp[x] ^ fp[y] * np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15), y))
    x, y = x[order], y[order]
    begins = np.flatnonzero(np.diff(y, prepend=-1))
    nth = np.arange(len(y)) - np.repeat(begins, np.diff(begins, append=len(y)))
    return x[nth < partners], y[nth < partners]


def _edges(units: Unit, size: np.ndarray, reach: int, partners: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of whole units of ``size`` rows each the edges between ids, or with ``partners`` the pairs that are nominated."""
    ends = np.cumsum(size)
    small = np.repeat(size <= SMALL_UNIT, size)
    own = tuple(c[small] for c in units)
    x, y = _small_pairs(own, size[size <= SMALL_UNIT], reach)
    if len(x):
        if partners is None:
            yield _star(own[2], x, y)
        else:
            x, y = _drawn(own[1], x, y, partners)
            yield own[2][x], own[2][y]
    for k in np.flatnonzero(size > SMALL_UNIT).tolist():
        own = tuple(c[ends[k] - size[k] : ends[k]] for c in units)
        pairs = [p if partners is None else _drawn(own[1], *p, partners) for p in _pairs(own, reach)]
        x, y = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        if len(x):
            yield _star(own[2], x, y) if partners is None else (own[2][x], own[2][y])


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of sorted rows, of which the first three name a unit, and each unit's rows. A unit is never cut; the last of a batch waits."""
    held: list[list[np.ndarray]] = []
    for b in (x for x in batches if x.num_rows):
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        before = held[-1] if held else new
        change = [any(p[-1] != c[0] for p, c in zip(before[:3], new[:3], strict=True)), *np.any([c[1:] != c[:-1] for c in new[:3]], axis=0)]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(new)
            continue
        done = [*held, [c[: cuts[-1]] for c in new]]
        held = [[c[cuts[-1] :] for c in new]]
        yield from _sized([np.concatenate(c) for c in zip(*done, strict=True)])
    if held:
        yield from _sized([np.concatenate(c) for c in zip(*held, strict=True)])


def _sized(columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    if len(columns[0]):
        begins = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]))
        yield columns, np.diff(begins, append=len(columns[0]))


def near_edges(distinct: DataFrame, reach: int, shard_size: int = SHARD_FINGERPRINTS, keep: Callable[[DataFrame], DataFrame] = written, partners: int | None = None) -> DataFrame:
    """Edges (a, b) of ids that connect all of ``distinct(fp, id)`` within ``reach`` bits, as chains of such links do.

    With ``partners`` they are pairs within ``reach`` instead, at most so many for each fingerprint and unit, for a
    caller that has yet to judge them. ``keep`` writes them as a table.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_FINGERPRINTS).toArrow().column(0).to_numpy()
    tree = spark.sparkContext.broadcast(VantagePointTree(sample.astype(np.int64).view(np.uint64), min(MAX_SHARDS, -(-n // shard_size)), reach))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, shard, home = tree.value.visits(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["shard", "home", "fp", "id"])

    with scratch(spark) as held:
        visits = held(distinct.select("fp", "id").mapInArrow(visit, "shard long, home boolean, fp long, id long"))
        return keep(_linked_visits(visits, reach, partners, held))


def _linked_visits(visits: DataFrame, reach: int, partners: int | None, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges that the tree's visits (shard, home, fp, id) find: they meet by shard, run of bits and value; crowds are cut into units."""
    each = [F.struct((F.col("shard") * (reach + 1) + k).alias("run"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(int(mask.view(np.int64)))).alias("value")) for k, (shift, mask) in enumerate(runs(reach))]
    met = visits.select("home", "fp", "id", F.explode(F.array(*each)).alias("at")).select("at.run", "at.value", "home", "fp", "id")
    sizes = met.groupBy("run", "value").agg(F.count_if("home").alias("residents"), F.count("*").alias("all"))
    crowds = sizes.where((F.col("residents") > UNIT_RESIDENTS) | (F.col("all") > UNIT_VISITORS))
    cut = held(crowds.select("run", "value", F.ceil(F.col("residents") / UNIT_RESIDENTS).alias("blocks"), F.ceil(F.col("all") / UNIT_VISITORS).alias("chunks")))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 14):
            home, fp, blocks, chunks = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6))
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block, chunk = (mixed % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64), ((mixed >> np.uint64(9)) % np.maximum(chunks, 1).astype(np.uint64)).astype(np.int64)
            # As a visitor to every block of its crowd, in the row's own chunk; as a resident to every chunk of its own block.
            each = np.repeat(np.arange(len(fp)), blocks)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            more = np.repeat(np.flatnonzero(home), chunks[home])
            other = np.arange(len(more)) - np.repeat(np.cumsum(chunks[home]) - chunks[home], chunks[home])
            keep = other != chunk[more]
            more, other = more[keep], other[keep]
            at = np.concatenate([each, more])
            cell = (np.concatenate([nth, block[more]]) << 32) + np.concatenate([chunk[each], other])
            resident = np.concatenate([home[each] & (nth == block[each]), np.ones(len(more), bool)])
            visitor = np.concatenate([np.ones(len(each), bool), np.zeros(len(more), bool)])
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(cell), b.column(3).take(where), b.column(4).take(where), pa.array(resident), pa.array(visitor)], ["run", "value", "cell", "fp", "id", "resident", "visitor"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (run, _, _, fp, ids, resident, visitor), size in _whole_units(batches):
            for a, b in _edges((run % (reach + 1), fp.view(np.uint64), ids, resident, visitor), size, reach, partners):
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    sized = met.join(cut, ["run", "value"], "left").select("run", "value", "home", "fp", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    rows = sized.mapInArrow(units, "run long, value long, cell long, fp long, id long, resident boolean, visitor boolean")
    return rows.repartition("run", "value", "cell").sortWithinPartitions("run", "value", "cell").mapInArrow(link, "a long, b long")


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: the smallest node that it is connected with. ``keep`` writes the result as a table.

    Each round takes the smallest label next door and then the label's own label, so labels jump ahead; the rounds
    needed grow with the logarithm of a component's width. Each round's labels are a table that goes with the next round.
    """
    with scratch(edges.sparkSession) as held:
        both = held(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
        labels = held(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
        while True:
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            step = held(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
            ahead = step.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
            jumped = held(step.join(ahead, "label", "left").select("node", F.least("label", F.coalesce("ahead", "label")).alias("label"), "was"))
            if not jumped.where("label <> was").limit(1).count():
                return keep(jumped.select("node", "label"))
            labels = jumped.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``: the smallest doc_id reachable by links.

    Fingerprints link at ``reach`` or fewer differing bits, equal ones included. Texts without words (null, empty) have
    fingerprint 0 and link like others. A null doc_id stays null; its row links and carries links like any other, but its
    component's id is null only if no row of the component has an id. Repeated rows are repeated; an empty table gives
    no rows.
    """
    prints = written(fingerprints(docs, words))
    with scratch(docs.sparkSession) as held:
        distinct = held(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        label = F.coalesce("label", "fp")
        found = components(near_edges(distinct.select("fp", F.col("fp").alias("id")), reach, keep=held), keep=held)
        labelled = held(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", label.alias("label")))
        component = written(labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id"))
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")
