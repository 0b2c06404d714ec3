"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.llm import simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "Éa", "c\xa0d", " ", "\n", "x"]), max_size=12).map(" ".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def groups(fps, reach):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for a, b in zip(*np.nonzero(d <= reach), strict=True):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("shard", [16, 10_000])
def test_links_equal_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    fps = list(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for k in range(300):  # clusters, and chains that reach across shards
        fps.append(fps[random.Random(k).randrange(len(fps))] ^ np.uint64(1 << int(rng.integers(64))))
    fps = np.array(sorted(set(map(int, fps))), np.uint64)
    frame = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp bigint, id bigint")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.near_edges(frame, 2, shard)).collect()}
    assert [labels.get(k, k) for k in range(len(fps))] == groups(fps, 2)


def test_units_split_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT_RESIDENTS", 7)
    monkeypatch.setattr(simhash, "UNIT_VISITORS", 9)
    fps = np.array([k * 2654435761 % (1 << 40) for k in range(120)] + [1 << b for b in range(40)], np.uint64)
    frame = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp bigint, id bigint")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.near_edges(frame, 2)).collect()}
    want = groups(fps, 2)
    assert [labels.get(k, k) for k in range(len(fps))] == want


def test_rows_grow_with_fingerprints(spark, monkeypatch):
    """Five times the fingerprints make five times the visits, however many shards a tree could have; a level more multiplies them."""
    whole, counts = simhash._linked_visits, []
    monkeypatch.setattr(simhash, "_linked_visits", lambda visits, *a: counts.append(visits.count()) or whole(visits, *a))
    for n in (3000, 15000):
        fps = np.unique(np.random.default_rng(7).integers(-(1 << 63), 1 << 63, n))
        frame = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps)], "fp bigint, id bigint")
        simhash.near_edges(frame, 3, 64, partners=3).count()
    assert counts[1] < 6 * counts[0]


def test_small_and_large_units_find_the_same(monkeypatch):
    """Pairs in units of all sizes against all pairs, each in the first run of bits in which the two agree."""
    rng = np.random.default_rng(5)
    size = np.array([1, 2, 63, 64, 65, 3, 200, 1])
    nth, fp = np.repeat(rng.integers(0, 4, len(size)), size), rng.integers(0, 1 << 12, size.sum()).astype(np.uint64)
    fp = np.unique(np.concatenate([fp + (np.arange(len(fp), dtype=np.uint64) << np.uint64(50)), fp]))[: size.sum()]
    fp = rng.permutation(fp)
    unit = (nth, fp, np.arange(size.sum()), rng.random(size.sum()) < 0.5, rng.random(size.sum()) < 0.7)
    name, found = np.repeat(np.arange(len(size)), size), []
    for small in (0, 64, 1000):
        monkeypatch.setattr(simhash, "SMALL_UNIT", small)
        found.append({(int(a), int(b)) for x, y in simhash._edges(unit, size, 3, 1 << 30) for a, b in zip(x, y, strict=True)})
    want = set()
    for a in np.flatnonzero(unit[3]):
        for b in np.flatnonzero(unit[4] & (name == name[a])):
            apart = int(fp[a] ^ fp[b])
            if a != b and apart.bit_count() <= 3 and all(apart >> s & int(m) for s, m in simhash.runs(3)[: nth[a]]):
                want.add((int(a), int(b)))
    assert want and found == [want] * 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert labels == {k: 0 for k in range(61)} | {100: 100, 101: 100}


ROWS = [(3, "a b c d"), (9, "A B C D"), (2, None), (5, ""), (None, "z z z"), (7, "z z z"), (3, "a b c d"), (8, " ".join(map(str, range(50000))))]


def test_rows(spark):
    frame = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id bigint, text string, fp int")
    got = sorted(repr((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in simhash.near_duplicates(frame).collect())
    component = {3: 3, 9: 3, 2: 2, 5: 2, None: 7, 7: 7, 8: 8}
    assert got == sorted(repr((i, plain(t), component[i])) for i, t in ROWS)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_a_fingerprint_without_id_bridges_two_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, words=3, seed=42: int(text))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words=3: docs.selectExpr("doc_id", "CAST(text AS BIGINT) fp"))
    frame = spark.createDataFrame([(7, "1"), (None, "3"), (9, "15"), (None, "4080"), (2, "65280")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert got == {(7, 1): 7, (None, 3): 7, (9, 15): 7, (None, 4080): None, (2, 65280): 2}
