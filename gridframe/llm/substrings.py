"""Removal of passages that a document with a smaller id has too, by fixed-block anchors.

A passage of ``window`` words holds a whole block of ``(window + 1) // 2`` words wherever its document is cut into
blocks without overlap. So the index has each document's blocks, and every rolling block of every document probes it.
Probes that hit a block of another document are extended: all windows around the hit, on both sides, are compared in
full, and the windows that an earlier document has too join to the maximal repeats that are removed.

Hashes travel as packed arrays, one row per task and bucket of hashes, and a task sends a hash once, however many of its
documents have it: a passage that a third of all documents share costs its bucket one entry per task. What was found
travels to the documents, which are dealt over groups by a hash of their id. The number of buckets and groups follows
from the bytes of text, so one holds about ``GROUP_BYTES`` of it whatever the input; a task takes its buckets, or groups,
one after another in sorted order and holds one at a time.

A block hash counts as 32 bits and its bucket: it only nominates. A window is told apart by a 64-bit hash and, by
another hash, its bucket. Two different windows are then taken for one with a probability of 1 in 2^64 times the
buckets: among the 5e9 windows of 60 GB of text 2e-4 such pairs are expected, among those of 100 TB about 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import MEMO_ENTRIES, MEMO_ENTRY_BYTES, memo, scratch, slices, written

WINDOW_WORDS = 13
#: Words that a task hashes at once; bounds its arrays.
FLUSH_WORDS = 700_000
#: Bytes of text whose hashes make a bucket, and of the documents of a group.
GROUP_BYTES = 32 << 20

BLOCK, ROLLING, SHARED_BLOCK, SHARED_ROLLING, RUNS, KEYS, WINDOWS, DOCUMENT, DONE = range(9)
ROW = "slot int, kind int, bucket int, docs binary, counts binary, data binary"
_NAMES = ["slot", "kind", "bucket", "docs", "counts", "data"]

_U32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_ENTRY_BYTES:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U32)


def _rolling(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every k words in a row; the last k - 1 places have none."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        out ^= out >> np.uint64(29)
    return _mix(out)


def _slot(x: np.ndarray, slots: int) -> np.ndarray:
    """Even shares of a hash's upper half."""
    return (((x >> _U32) * np.uint64(slots)) >> _U32).astype(np.int64)


class _Docs:
    """Documents of one flush: ids, words, and the words' hashes one after another."""

    def __init__(self, ids: list[int], words: list[list[bytes]]):
        self.words = words
        self.ids = np.array(ids, np.int64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        known = memo("substrings", _WordHashes)
        self.hashes = np.fromiter((known[w] for doc in words for w in doc), np.uint64, int(self.sizes.sum()))
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.starts[self.row]
        # What was found at places of a row must not reach another row with the same id, so places travel with a key of both.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.hashes + self.place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))])
        text = sums[self.starts[1:]] - sums[self.starts[:-1]]
        self.keys = _mix(text + _mix(self.ids.view(np.uint64) + np.uint64(1))).view(np.int64)

    def whole(self, k: int) -> np.ndarray:
        """The places from which k words of the same document follow."""
        return np.flatnonzero(self.place + k <= self.sizes[self.row])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def _packed(kind: int, bucket: int | None, group: np.ndarray, docs: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """A row per ``group``, which becomes its slot: entries by document, a document's id and number of entries once."""
    order = np.lexsort((docs, group))
    group, docs, data = group[order], docs[order], data[order]
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = docs[a:b]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        counts = np.diff(np.concatenate([first, [b - a]])).astype("<u4")
        slot = int(group[a])
        yield slot, kind, slot if bucket is None else bucket, own[first].astype("<i8").tobytes(), counts.tobytes(), data[a:b].tobytes()


def _entries(row: tuple, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's document and data."""
    return np.repeat(np.frombuffer(row[3], "<i8"), np.frombuffer(row[4], "<u4")), np.frombuffer(row[5], dtype)


def _runs(places: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and packed (first, length) of consecutive places of one row."""
    if not len(places):
        return row, np.zeros(0, "<u8")
    cut = np.concatenate([[0], np.flatnonzero((np.diff(places) != 1) | (np.diff(row) != 0)) + 1, [len(places)]])
    return row[cut[:-1]], (places[cut[:-1]].astype(np.uint64) << _U32) | np.diff(cut).astype(np.uint64)


def _doc_slots(ids: np.ndarray, slots: int) -> np.ndarray:
    return _slot(_mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)), slots)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _flushes(docs: Iterator[tuple[int, bytes]]) -> Iterator[_Docs]:
    ids, words, n = [], [], 0
    for doc, text in docs:
        ids.append(doc)
        words.append(text.split())  # bytes split at ASCII white space alone
        n += len(words[-1])
        if n >= FLUSH_WORDS:
            yield _Docs(ids, words)
            ids, words, n = [], [], 0
    if ids:
        yield _Docs(ids, words)


def _probe(flush: _Docs, block: int, slots: int) -> Iterator[tuple]:
    """What a flush tells the buckets: its blocks and rolling blocks; and what it tells its own documents."""
    at = flush.whole(block)
    key = _rolling(flush.hashes, block, block)[at] if len(at) else np.zeros(0, np.uint64)
    aligned = flush.place[at] % block == 0
    order = np.argsort(key, kind="stable")
    key, at, aligned = key[order], at[order], aligned[order]
    if not len(key):
        return
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(key)]]))
    row = flush.row[at]
    shared = row[first] != row[first + size - 1]  # a stable sort keeps rows in order within a key
    some_block = np.logical_or.reduceat(aligned, first)
    bucket, low = _slot(key[first], slots), (key[first] & _LOW).astype("<u4")
    for kind, chosen in ((BLOCK, ~shared & some_block), (ROLLING, ~shared & ~some_block)):
        yield from _packed(kind, None, bucket[chosen], flush.ids[row[first[chosen]]], low[chosen])
    for kind, chosen in ((SHARED_BLOCK, shared & some_block), (SHARED_ROLLING, shared & ~some_block)):
        yield from _packed(kind, None, bucket[chosen], np.zeros(int(chosen.sum()), np.int64), low[chosen])
    hit = np.sort(at[np.repeat(shared, size)])
    rows, runs = _runs(flush.place[hit], flush.row[hit])
    yield from _packed(RUNS, 0, _doc_slots(flush.ids[rows], slots), flush.keys[rows], runs)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of one slot after another; they come sorted by slot."""
    for slot, rows in groupby(_rows(batches), lambda row: row[0]):
        yield slot, list(rows)


def _match_blocks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """In each bucket: keys that are a block of one entry and occur in another go back to the entries' documents."""
    for bucket, rows in _buckets(batches):
        passed = [row for row in rows if row[1] == RUNS]
        if passed:
            yield _batch(passed)
        yield from _matched(bucket, [row for row in rows if row[1] != RUNS], slots)


def _matched(bucket: int, rows: list[tuple], slots: int) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    docs, keys = (list(x) for x in zip(*(_entries(row, "<u4") for row in rows), strict=True))
    kinds = np.repeat([row[1] for row in rows], [len(k) for k in keys])
    key, doc = np.concatenate(keys), np.concatenate(docs)
    del keys, docs
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(key)]]))
    hit = (size > 1) & np.logical_or.reduceat(np.isin(kinds, (BLOCK, SHARED_BLOCK))[order], first)
    chosen = order[np.repeat(hit, size)]
    chosen = chosen[np.isin(kinds[chosen], (BLOCK, ROLLING))]
    found = list(_packed(KEYS, bucket, _doc_slots(doc[chosen], slots), doc[chosen], key[chosen]))
    for at in range(0, len(found), 64):
        yield _batch(found[at : at + 64])


class _Found:
    """What came back to the documents of a part: runs of places, and hashes to look for."""

    def __init__(self):
        self.runs, self.keys = [], []

    def add(self, row: tuple, dtype: str) -> None:
        doc, data = _entries(row, "<u8" if row[1] == RUNS else dtype)
        if row[1] == RUNS:
            self.runs.append((doc, data))
        else:
            self.keys.append((doc, data.astype(np.uint64) | (np.uint64(row[2]) << _U32) if dtype == "<u4" else data))

    def seal(self) -> None:
        for name in ("runs", "keys"):
            parts = getattr(self, name)
            doc, data = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.argsort(doc, kind="stable")
            setattr(self, name, (doc[order], data[order]))

    def of(self, which: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, as places in ``ids``, and data."""
        a, b = np.searchsorted(which[0], ids), np.searchsorted(which[0], ids, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(ids)), n), which[1][at]

    def mark(self, flush: _Docs, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The places of the flush that runs cover or whose key is looked for; ``key`` belongs to the places ``at``."""
        out = np.zeros(len(flush.hashes) + 1, np.int32)
        rows, runs = self.of(self.runs, flush.keys)
        if len(rows):
            begin = flush.starts[rows] + (runs >> _U32).astype(np.int64)
            np.add.at(out, begin, 1)
            np.add.at(out, begin + (runs & _LOW).astype(np.int64), -1)
        out = np.cumsum(out)[:-1] > 0
        rows, keys = self.of(self.keys, flush.ids)
        if len(rows):
            has = np.zeros(len(flush.ids), bool)
            has[rows] = True
            some = has[flush.row[at]]
            both = lambda row, k: _mix(k + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            out[at[some][np.isin(both(flush.row[at][some], key[some]), both(rows, keys))]] = True
        return out


def _found_flushes(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[_Found, _Docs]]:
    """The documents of one group after another, with what was found in them; that sorts before them."""
    unzip = zstandard.ZstdDecompressor()
    for _, rows in groupby(_rows(batches), lambda row: row[0]):
        found = _Found()

        def documents(rows: Iterator[tuple] = rows, found: _Found = found) -> Iterator[tuple[int, bytes]]:
            sealed = False
            for row in rows:
                if row[1] != DOCUMENT:
                    found.add(row, dtype)
                    continue
                if not sealed:
                    found.seal()
                    sealed = True
                yield int.from_bytes(row[3], "little", signed=True), unzip.decompress(row[5])

        for flush in _flushes(documents()):
            yield found, flush


def _result(doc: int | None, words: list[bytes], keep: np.ndarray | None, digest: bool) -> tuple:
    kept = words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    text = b" ".join(kept)
    return doc, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")


def _words_hash(words: list[bytes]) -> int:
    """As Spark's xxhash64 of the text with single blanks."""
    h = xxhash.xxh64_intdigest(b" ".join(words), 42)
    return h - (1 << 64) if h >> 63 else h


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, digest: bool = False, changed_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space. A word goes if it lies in ``window`` words in a row that also start
    somewhere in a document with a smaller doc_id; that is judged on the input, not on what is left. ``kept`` is the
    rest, joined by single blanks, or with ``digest`` the hexadecimal SHA-256 of its UTF-8, which spares keeping texts.
    With ``changed_only`` rows that lose nothing are left out, and so are their texts on the way;
    a fifth column, ``words_hash``, tells rows of one doc_id apart: xxhash64 of all words joined by single blanks.
    A null text has no words. A row without doc_id neither loses words nor makes others lose any. Rows with the same
    doc_id are one document in two parts: neither takes from the other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text")
    known = rows.where("doc_id IS NOT NULL")
    tasks, block = int(spark.conf.get("spark.sql.shuffle.partitions")), (window + 1) // 2
    size = known.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).collect()[0][0]  # one number
    slots = max(tasks, -(-size // GROUP_BYTES))
    result = "doc_id long, n_words long, n_removed long, kept string" + (", words_hash long" if changed_only else "")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d, (t or "").encode()) for b in slices(batches) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for flush in _flushes(texts):
            yield _batch(list(_probe(flush, block, slots)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = _doc_slots(ids, slots)
            yield _batch([(int(s), DOCUMENT, 0, int(d).to_bytes(8, "little", signed=True), None, zip_.compress((t or "").encode())) for s, d, t in zip(slot, ids, b.column(1).to_pylist(), strict=True)])

    def parts(df: DataFrame) -> DataFrame:
        """Slots in order within tasks, and kinds in order within slots."""
        dealt = df.repartitionById(tasks, F.expr(f"CAST(slot * {tasks}L DIV {slots} AS INT)"))
        return dealt.sortWithinPartitions("slot", "kind")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows around the hits; documents without any are done."""
        zip_ = zstandard.ZstdCompressor(level=1)
        for found, flush in _found_flushes(batches, "<u4"):
            out: list[tuple] = []
            at = flush.whole(block)
            key = _rolling(flush.hashes, block, block)[at] if len(at) else np.zeros(0, np.uint64)
            key = (key & _LOW) | (_slot(key, slots).astype(np.uint64) << _U32)
            hit = np.concatenate([found.mark(flush, at, key), np.zeros(window, bool)])
            near = hit[: len(flush.hashes)].copy()
            for j in range(1, window - block + 1):
                near |= hit[j : j + len(near)]
            at = flush.whole(window)
            at = at[near[at]]
            waits = np.zeros(len(flush.ids), bool)
            if len(at):
                waits[flush.row[at]] = True
                # One hash travels, the other decides on the bucket: windows that meet by chance agree in 64 bits and a bucket.
                one, two = (_rolling(flush.hashes, window, seed)[at] for seed in (101, 202))
                ids = flush.ids[flush.row[at]]
                order = np.lexsort((ids, two, one))
                one, two, ids, at = one[order], two[order], ids[order], at[order]
                first = np.concatenate([[0], np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1])
                size = np.diff(np.concatenate([first, [len(one)]]))
                least = np.repeat(ids[first], size)
                covered = np.sort(at[ids > least])
                row, runs = _runs(flush.place[covered], flush.row[covered])
                out += _packed(RUNS, 0, _doc_slots(flush.ids[row], slots), flush.keys[row], runs)
                out += _packed(WINDOWS, None, _slot(two[first], slots), ids[first], one[first].astype("<u8"))
            for k, words in enumerate(flush.words):
                doc = int(flush.ids[k]).to_bytes(8, "little", signed=True)
                if waits[k]:
                    out.append((int(_doc_slots(flush.ids[k : k + 1], slots)[0]), DOCUMENT, 0, doc, None, zip_.compress(b" ".join(words))))
                elif not changed_only:
                    _, n, _, kept = _result(None, words, None, digest)
                    out.append((0, DONE, 0, doc, n.to_bytes(8, "little"), kept.encode() if digest else zip_.compress(kept.encode())))
            for k in range(0, len(out), 256):
                yield _batch(out[k : k + 256])

    # The hits are a table before the documents move, and the table goes when they have: no two shuffles wait on disk at once.
    with scratch(spark) as held:
        hits = held(parts(known.mapInArrow(probe, ROW)).mapInArrow(lambda it: _match_blocks(it, slots), ROW))
        stage = written(parts(hits.unionByName(known.mapInArrow(send, ROW))).mapInArrow(extend, ROW))

    def match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each bucket: windows of which an earlier document has the same go back to the documents."""
        for _, rows in _buckets(batches):
            doc, a = (np.concatenate(x) for x in zip(*(_entries(row, "<u8") for row in rows), strict=True))
            order = np.lexsort((doc, a))
            a, doc = a[order], doc[order]
            first = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
            late = doc > np.repeat(doc[first], np.diff(np.concatenate([first, [len(a)]])))
            back = list(_packed(KEYS, 0, _doc_slots(doc[late], slots), doc[late], a[late]))
            for at in range(0, len(back), 64):
                yield _batch(back[at : at + 64])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, flush in _found_flushes(batches, "<u8"):
            at = flush.whole(window)
            key = _rolling(flush.hashes, window, 101)[at] if len(at) else np.zeros(0, np.uint64)
            starts = found.mark(flush, at, key)
            edge = np.zeros(len(starts) + window, np.int32)
            edge[: len(starts)] += starts
            edge[window:] -= starts
            keep = np.cumsum(edge)[: len(starts)] == 0
            rows = [_result(int(d), w, keep[a:b], digest) for d, w, a, b in zip(flush.ids, flush.words, flush.starts, flush.starts[1:], strict=False)]
            yield from results([(*r, _words_hash(w)) for r, w in zip(rows, flush.words, strict=True)] if changed_only else rows)

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 256):
            columns = list(zip(*rows[k : k + 256], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())[: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "words_hash"][: len(columns)])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            found = [(int.from_bytes(r[3], "little", signed=True), int.from_bytes(r[4], "little"), 0, (r[5] if digest else unzip.decompress(r[5])).decode("utf-8", "replace")) for r in _rows(iter([b]))]
            yield from results(found)

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield from results([_result(None, (t or "").encode().split(), None, digest) for t in b.column(1).to_pylist()])

    late = parts(stage.where(f"kind = {WINDOWS}")).mapInArrow(match_windows, ROW)
    back = parts(late.unionByName(stage.where(f"kind IN ({RUNS}, {DOCUMENT})")))
    finished = back.mapInArrow(finish, result)
    if changed_only:
        return finished.where("n_removed > 0")
    return finished.unionByName(stage.where(f"kind = {DONE}").mapInArrow(done, result)).unionByName(rows.where("doc_id IS NULL").mapInArrow(nameless, result))


def deduplicated(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every text that lost words replaced by what is kept and n_chars by its length; other rows as they are.

    Where an id repeats, each row takes its own result, found by id and words; rows that agree in both have one result.
    A row without an id stays as it is.
    """
    changed = remove_repeats(docs, window, changed_only=True).groupBy(F.col("doc_id").alias("_id"), F.col("words_hash").alias("_hash")).agg(F.min("kept").alias("_kept"))
    words_hash = F.xxhash64(F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+", " ")))
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), words_hash.alias("_words"))
    joined = own.join(changed, (F.col("_doc") == F.col("_id")) & (F.col("_words") == F.col("_hash")), "left")
    new = {"text": F.coalesce("_kept", F.col("_row")["text"])}
    if "n_chars" in docs.columns:
        length = F.when(F.col("_kept").isNotNull(), F.length("_kept")).otherwise(F.col("_row")["n_chars"])
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
