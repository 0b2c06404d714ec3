"""Packing documents into sequences by patterns of lengths.

Only the histogram of lengths, at most one count per possible length, decides how to pack. Patterns of two or three
lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what is left over is packed best fit first, again as patterns with counts. The plan is
a bounded table; a document finds its place in it from its length and its rank among the documents of that length.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import memo, slices, texts, written
from gridframe.llm.tokens import Memo, vocabulary_path

PACK_VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
#: Texts whose distinct words are looked up together.
PACK_ROWS = 1024
#: Bound of the least-squares problem, whatever the data.
MAX_PATTERNS = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


#: Words that need no care: their matches can be found here as the vocabulary's own pattern finds them.
_PLAIN = re.compile(r"[!-@\[-~ß-öø-ÿ]*")
_MATCH = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-zß-öø-ÿ0-9\s]+")


def _encoder(path: str | None) -> Callable[[list[str]], list[bytes]]:
    """Encodes new words. Matches of plain ones are encoded once and kept, as a word's ids are those of its matches in a row."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t, bare = (Tokenizer.from_file(vocabulary_path(PACK_VOCABULARY, path)) for _ in range(2))
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[k for token, k in t.get_vocab().items() if token.endswith("</w>")]] = True
    # Matches of plain texts are as the vocabulary's normalizer leaves them, and a blank parts them as its pattern does.
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def each(new: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch_fast(new, add_special_tokens=False)]

    def encode_matches(new: list[str]) -> list[bytes]:
        """Encodes new matches as one text, unless the tokens that end a match don't tell them apart."""
        ids = np.array(bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(new):
            return each(new)
        cut, raw = [0, *(4 * stops).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    matches = Memo(encode_matches)

    def encode_plain(new: list[str]) -> list[bytes]:
        parts = [_MATCH.findall(x) for x in new]
        codes = matches.codes([list(chain.from_iterable(parts))])[0]
        ends_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))])
        cut = [0, *ends_at[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))].tolist()]
        raw = b"".join(codes)
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_words(new: list[str]) -> list[bytes]:
        together = " ".join(new)
        if _PLAIN.fullmatch(together.replace(" ", "")) and "<|" not in together:
            return encode_plain(new)
        plain = [_PLAIN.fullmatch(x) is not None and "<|" not in x for x in new]
        easy, rest = (iter(f([x for x, own in zip(new, plain, strict=True) if own == kind])) for f, kind in ((encode_plain, True), (each, False)))
        return [next(easy if own else rest) for own in plain]

    return encode_words


def _text_encoder(path: str | None) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts: each distinct word of theirs is looked up once, and a text's ids are those of its words in a row."""
    known = Memo(_encoder(path))
    gc.freeze()  # memos are large and have no cycles: the collector needn't walk them again and again

    def encode(own: list[str]) -> list[bytes]:
        parted = pc.ascii_split_whitespace(pa.array([lowered(x) for x in own], pa.large_string()))
        each = parted.flatten().dictionary_encode()
        codes = pa.array(known.codes([each.dictionary.to_numpy(zero_copy_only=False).tolist()])[0], pa.large_binary()).take(each.indices)
        _, at, ids = codes.buffers()
        cut, raw = np.frombuffer(at, np.int64)[parted.offsets.to_numpy()].tolist(), memoryview(ids or b"")
        return [bytes(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    return encode


def lowered(text: str) -> str:
    """The vocabulary takes capitals as small letters; here A-Z are, and others where all characters are of Latin-1."""
    if "<|" in text:  # it may have a special string, in which case counts
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode().lower().decode()
    return text.lower()


def words(text: str) -> list[str]:
    """One text's words. The vocabulary drops white space before it matches, so it always ends a match."""
    return lowered(text).replace("\n", " ").replace("\t", " ").split(" ")


def cut_into_pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, path: str | None = None) -> DataFrame:
    """Rows of ``PIECES`` for ``docs(doc_id, text)``; ``nth`` numbers the pieces of a length within the task ``part``."""
    separator = np.array([SEPARATOR_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = memo(f"pack {path}", lambda: _text_encoder(path)), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches, PACK_ROWS):
            out = []
            for doc, own in zip(b.column(0).to_pylist(), encode(texts(b.column(1))), strict=True):
                ids = own + separator
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    n = len(body) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(body), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text")
    return rows.mapInArrow(run, PIECES)


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that add up to ``capacity``: all pairs, and triples as evenly as they fit the bound."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    a = lengths[lengths <= capacity // 2]
    pairs = a[present[capacity - a]]
    out = [np.stack([capacity - pairs, pairs, np.zeros_like(pairs)], 1)]
    large = lengths[(lengths >= (capacity + 2) // 3) & (lengths < capacity)]
    each = max(1, MAX_PATTERNS // max(1, len(large)))
    for x in large:
        rest = capacity - x
        b = lengths[(lengths <= min(x, rest - 1)) & (2 * lengths >= rest)]
        b = b[present[rest - b]]
        if len(b) > each:
            b = b[np.linspace(0, len(b) - 1, each).astype(int)]
        out.append(np.stack([np.full_like(b, x), b, rest - b], 1))
    return np.concatenate(out)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts against the histogram, by accelerated projected gradients."""
    size, k = len(histogram), len(patterns)
    use = histogram.astype(float).copy()
    use[0] = 0

    def total(x: np.ndarray) -> np.ndarray:
        t = sum(np.bincount(patterns[:, j], x, size) for j in range(3))
        t[0] = 0
        return t

    # A step of one over the largest eigenvalue is safe; power iteration finds that value.
    v = np.ones(k)
    for _ in range(20):
        t = total(v)
        v = sum(t[patterns[:, j]] for j in range(3))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(k)
    momentum = 1.0
    for _ in range(steps):
        r = total(y) - use
        new = np.maximum(0, y - sum(r[patterns[:, j]] for j in range(3)) / top)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, x, momentum = new + (momentum - 1) / faster * (new - x), new, faster
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> np.ndarray:
    """Runs of places, one row each: length, first rank, number of ranks, how many to a sequence, first sequence, first offset.

    ``histogram[n]`` counts the pieces of length n. Every piece gets exactly one place; no sequence exceeds ``capacity``.
    """
    left, taken = histogram.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, ...]] = []
    sequences = 0

    def emit(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        at = 0
        for n, m in pattern:
            runs.append((n, int(taken[n]), times * m, m, sequences, at))
            taken[n] += times * m
            left[n] -= times * m
            at += n * m
        sequences += times

    if left[capacity]:
        emit([(capacity, 1)], int(left[capacity]))
    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths, capacity) if len(lengths) else np.zeros((0, 3), int)
    if len(patterns):
        counts = np.floor(fit_counts(patterns, left)).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if not counts[k]:
                break
            own, m = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            if times := int(min(counts[k], (left[own] // m).min())):
                emit([(int(n), int(c)) for n, c in zip(own[::-1], m[::-1], strict=True)], times)
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        room, pattern = capacity, []
        while room and (k := np.searchsorted(lengths, room, "right")):
            n = int(lengths[k - 1])
            m = int(min(left[n], room // n))
            pattern.append((n, m))
            room -= n * m
            lengths = lengths[: k - 1]
        emit(pattern, int(min(left[n] // m for n, m in pattern)))
    return np.array(runs, np.int64).reshape(-1, 6)


def place(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces``, written rows of ``PIECES``, with sequence_id and offset.

    Ranks come from counts per task and length, so no task sorts or holds all pieces of one length.
    """
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per_task.select("part", "length", before.alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for n, count in pieces.groupBy("length").count().collect():  # a row for each length: at most ``capacity``
        histogram[n] = count
    runs = plan_sequences(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = pieces.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, _, m, sequence, at = plan.value.T
        keys = (n << 48) + first
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            k = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            nth = rank - first[k]
            out = [b.column(i) for i in range(5)] + [pa.array(sequence[k] + nth // m[k]), pa.array(at[k] + nth % m[k] * length)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(ranks, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for ``docs(doc_id, text)``.

    A document is its ids and a closing id 0, so an empty or null text is one token. A null doc_id stays null, repeated
    rows are packed each for itself, an empty table gives no rows.
    """
    return place(written(cut_into_pieces(docs, capacity, path)), capacity)
