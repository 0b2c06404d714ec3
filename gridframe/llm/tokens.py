"""Token counts and byte-level BPE over whole texts, however long.

A text above ``CHUNK_CHARS`` becomes overlapping chunks, a row each, that are dealt over tasks. A chunk starts anywhere,
even inside a word, so its first boundaries may be wrong. Both vocabularies cut a text into matches by a scan that
looks only ahead: two scans that begin a match at the same character agree from there on, as far as both see the same
text. So neighbours are spliced at the first match boundary inside their overlap that both report and that the end of
the earlier chunk cannot have moved; if they report none, or part again behind it, the text goes round again with the
overlap doubled, at last as one chunk. What is counted or encoded of a chunk lies between its two splices.

Counting encodes each chunk by the library, with offsets and the match of every token. Encoding cuts chunks by the
pattern alone first, splices, and then encodes the matches of each chunk in its own task; decoding joins raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import MEMO_ENTRIES, MEMO_ENTRY_BYTES, memo, scratch, slices, texts, written

COUNT_VOCABULARY = "byte_bpe_50k.json"
BPE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Characters of a chunk and of the first overlap with the next one.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
#: Characters before a chunk's end in which its boundaries may differ from the whole text's: more than the longest
#: contraction, look-ahead or special string of the vocabularies.
MARGIN_CHARS = 32

#: Boundaries in a chunk: match starts near its two ends, as places in the text, each with the tokens before it.
BOUNDS = "row long, doc_id long, k long, chunks long, overlap long, at array<long>, before array<long>, total long"
PARTS = "row long, doc_id long, k long, overlap long, begin long, end long, n long"
Mark = Callable[[str], tuple[np.ndarray, np.ndarray, int]]

_TWO_BLANKS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=[!-~\w])(?=[ \n\t\r])")


def pieces(text: str) -> list[str]:
    """``text`` cut between a character that is not white space and a blank or line feed, where both vocabularies start a
    match whatever is around; joined, the pieces give ``text`` back."""
    if not _TWO_BLANKS.search(text):
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[x if x[:1] == "\n" else " " + x for x in rest]]
    cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Memo(dict):
    """Encoded pieces. ``encode`` takes a list of new pieces; short ones are kept, up to ``MEMO_ENTRIES``."""

    def __init__(self, encode: Callable[[list[str]], list]):
        super().__init__()
        self.encode, self.long = encode, {}

    def __missing__(self, piece: str) -> object:
        return self.long[piece]

    def learn(self, docs: list[list[str]]) -> None:
        """Afterwards every piece of ``docs`` is there; long ones until the next call."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        self.long = {}
        new = [piece for piece in set().union(*docs) if piece not in self]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for piece, code in zip(part, self.encode(part), strict=True):
                (self if len(piece) <= MEMO_ENTRY_BYTES // 4 else self.long)[piece] = code

    def codes(self, docs: list[list[str]]) -> list[list]:
        """The codes of every document's pieces. Pieces are looked up once; only those that are lacking are learned."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        out = [list(map(self.get, doc)) for doc in docs]
        lacking = [[at for at, code in enumerate(codes) if code is None] for codes in out]
        self.learn([[doc[k] for k in at] for doc, at in zip(docs, lacking, strict=True) if at])
        for doc, codes, at in zip(docs, out, lacking, strict=True):
            for k in at:
                codes[k] = self[doc[k]]
        return out


def vocabulary_path(name: str, path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def library_memo(kind: str, path: str | None, build: Callable[[str | None], Callable[[list[str]], list]]) -> Memo:
    """The worker's memo for a vocabulary."""
    return memo(f"{kind} {path}", lambda: Memo(build(path)))


def _tokenizer(path: str | None) -> object:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(COUNT_VOCABULARY, path))


def _counter(path: str | None) -> Callable[[list[str]], list[int]]:
    t = _tokenizer(path)
    return lambda new: [len(x) for x in t.encode_batch_fast(new, add_special_tokens=False)]


def mark_tokens(path: str | None) -> Mark:
    """Marks by the library: where tokens begin that open a match, how many tokens come before each, and how many there are."""
    t = memo(f"tokenizer {path}", lambda: _tokenizer(path))

    def mark(text: str) -> tuple[np.ndarray, np.ndarray, int]:
        e = t.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        opens = np.flatnonzero((words != np.concatenate([[-2], words[:-1]])) | (words == -1))
        return offsets[opens, 0], opens, len(words)

    return mark


def mark_matches(path: str | None) -> Mark:
    """Marks by the pattern alone: where matches begin, counted themselves."""
    find = _pattern().finditer

    def mark(text: str) -> tuple[np.ndarray, np.ndarray, int]:
        begins = np.array([m.start() for m in find(text)], np.int64)
        return begins, np.arange(len(begins)), len(begins)

    return mark


def _pattern() -> object:
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def chunk_rows(long: DataFrame, chunk: int) -> DataFrame:
    """A row (row, doc_id, k, chunks, overlap, body) for each overlapping chunk of ``long(row, doc_id, overlap, text)``, dealt over tasks.

    A chunk has ``chunk`` characters and the overlap; with an overlap that the text does not exceed, it is the whole text.
    """
    fields = ["row", "doc_id", "k", "chunks", "overlap", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for row, doc, overlap, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                count = 1 if overlap >= len(text) else max(1, -(-len(text) // chunk))
                for k in range(count):
                    body = text if count == 1 else text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict(dict(zip(fields, ([row], pa.array([doc], pa.int64()), [k], [count], [overlap], [body]), strict=True)))

    rows = long.select("row", "doc_id", "overlap", "text").mapInArrow(run, "row long, doc_id long, k long, chunks long, overlap long, body string")
    return rows.repartition("row", "k")


def bounds(chunks: DataFrame, marker: Callable[[], Mark], chunk: int) -> DataFrame:
    """Rows of ``BOUNDS``: what each chunk reports of its two overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = marker()
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            body, overlap, last = row["body"], row["overlap"], row["k"] == row["chunks"] - 1
            at, before, total = mark(body)
            near = (at <= overlap) if row["k"] else np.zeros(len(at), bool)
            if not last:
                near |= (at >= chunk) & (at <= len(body) - MARGIN_CHARS)
            fields = [[row["row"]], [row["doc_id"]], [row["k"]], [row["chunks"]], [overlap], [at[near] + row["k"] * chunk], [before[near]], [total]]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, kinds, strict=True)], ["row", "doc_id", "k", "chunks", "overlap", "at", "before", "total"])

    return chunks.mapInArrow(run, BOUNDS)


def meeting(at: np.ndarray, other: np.ndarray, least: int) -> int | None:
    """The first boundary from ``least`` on that a chunk and the next one share, if they agree on all that follow it in the overlap."""
    mine = at[at >= least]
    yours = other[(other >= least) & (other <= (mine[-1] if len(mine) else -1))]
    both = np.intersect1d(mine, yours)
    if not len(both):
        return None
    p = int(both[0])
    return p if np.array_equal(mine[mine >= p], yours[yours >= p]) else None


def splice(found: DataFrame, chunk: int) -> DataFrame:
    """Rows of ``PARTS``: each chunk's share of its text, begin to end (-1: the text's end), and the tokens in it.

    A chunk that does not meet its next one ends in null. A text's bounds are a stream of one task, which holds two chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, before = None, 0, 0
        out: list[tuple] = []
        for b in slices(batches):
            for r in b.to_pylist():
                if held is not None:
                    at, other = np.array(held["at"], np.int64), np.array(r["at"], np.int64)
                    middle = r["k"] * chunk
                    p = meeting(at, other, max(middle + 1, begin))
                    n = None if p is None else held["before"][int(np.flatnonzero(at == p)[-1])] - before
                    out.append((held["row"], held["doc_id"], held["k"], held["overlap"], begin, p, n))
                    begin, before = (middle, 0) if p is None else (p, r["before"][int(np.flatnonzero(other == p)[0])])
                held = r
                if r["k"] == r["chunks"] - 1:
                    out.append((r["row"], r["doc_id"], r["k"], r["overlap"], begin, -1, r["total"] - before))
                    held, begin, before = None, 0, 0
            yield parts(out)
            out = []

    def parts(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "doc_id", "k", "overlap", "begin", "end", "n"])

    return found.repartition("row").sortWithinPartitions("row", "k").mapInArrow(run, PARTS)


def resynchronised(long: DataFrame, marker: Callable[[], Mark], chunk: int, overlap: int, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``PARTS`` for ``long(row, doc_id, text)``, a table: rounds with doubled overlaps until every text is spliced.

    A round takes only the texts that the one before could not splice; the overlap at last covers a text, so rounds end.
    """
    parts, open_rows = [], long.withColumn("overlap", F.lit(overlap).cast("long"))
    while True:
        own = held(splice(bounds(chunk_rows(open_rows, chunk), marker, chunk), chunk))
        parts.append(own)
        failed = own.where("end IS NULL").select("row", F.col("overlap") * 2).distinct().toDF("row", "overlap")
        if not failed.limit(1).count():
            break
        parts[-1] = own.join(failed, "row", "left_anti").select(*own.columns)
        open_rows = long.join(failed, "row")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text")


def _long(docs: DataFrame, longest: int) -> DataFrame:
    """The rows above ``longest`` characters with a number each; to be written, which fixes the numbers."""
    return _rows(docs).where(F.length("text") > longest).withColumn("row", F.monotonically_increasing_id())


def _short(docs: DataFrame, longest: int) -> DataFrame:
    return _rows(docs).where(F.coalesce(F.length("text"), F.lit(0)) <= longest)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 tokens); a null doc_id stays null; repeated rows give repeated results; an empty
    table gives none. Special strings inside a text count as the library's default has it. Texts of up to ``chunk``
    characters are counted where they are read, the others chunk by chunk; only these are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library_memo("count", path, _counter)
        for b in slices(batches):
            n = pa.array(map(sum, known.codes([pieces(x) for x in texts(b.column(1))])), pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], ["doc_id", "n_bytes", "n_tokens"])

    short = _short(docs, chunk).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    with scratch(docs.sparkSession) as held:
        long = held(_long(docs, chunk))
        if not long.limit(1).count():
            return short.withColumn("over_limit", F.col("n_tokens") > limit)
        sums = resynchronised(long, lambda: mark_tokens(path), chunk, overlap, held).groupBy("row").agg(F.sum("n").alias("n_tokens"))
        counted = written(long.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(sums, "row").select("doc_id", "n_bytes", "n_tokens"))
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(vocabulary_path(BPE_VOCABULARY, path), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _encoding(path: str | None) -> object:
    import public_tokenizers
    import tiktoken

    return memo(f"ranks {path}", lambda: tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={}))


def encode_bpe(docs: DataFrame, path: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id and ids, as little-endian unsigned 32-bit integers.

    A null text counts as empty (no ids); null ids stay null; repeated rows are repeated; an empty table gives none.
    ``decode_bpe`` is the inverse. Texts of up to ``chunk`` characters are encoded where they are read, the others chunk
    by chunk; only these are shuffled. A text's ids are one value, so one row holds them in the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in slices(batches):
            ids = pa.array([np.array(encode(x), "<u4").tobytes() for x in texts(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The matches that begin in a chunk's share; the scan starts at a match and sees the whole chunk."""
        encode, find = _encoding(path).encode_ordinary, _pattern().finditer
        for b in slices(batches, 1):
            r = b.to_pylist()[0]
            start = 0 if r["chunks"] == 1 else r["k"] * chunk
            end = len(r["body"]) if r["end"] == -1 else r["end"] - start
            out: list[int] = []
            for m in find(r["body"], r["begin"] - start):
                if m.start() >= end:
                    break
                out += encode(m[0])
            yield pa.RecordBatch.from_pydict({"row": [r["row"]], "doc_id": pa.array([r["doc_id"]], pa.int64()), "k": [r["k"]], "ids": [np.array(out, "<u4").tobytes()]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, doc, ids = None, None, []
        for b in slices(batches):
            for r in b.to_pylist():
                if r["row"] != row and row is not None:
                    yield one(doc, ids)
                    ids = []
                row, doc = r["row"], r["doc_id"]
                ids.append(r["ids"])
        if row is not None:
            yield one(doc, ids)

    def one(doc: int | None, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([b"".join(ids)], pa.binary())], ["doc_id", "ids"])

    short = _short(docs, chunk).mapInArrow(run, "doc_id long, ids binary")
    with scratch(docs.sparkSession) as held:
        long = held(_long(docs, chunk))
        if not long.limit(1).count():
            return short
        parts = resynchronised(long, lambda: mark_matches(path), chunk, overlap, held)
        used = long.join(parts.select("row", "overlap").distinct(), "row")
        shares = chunk_rows(used, chunk).join(parts.select("row", "k", "begin", "end"), ["row", "k"])
        encoded = shares.mapInArrow(encode_parts, "row long, doc_id long, k long, ids binary")
        whole = written(encoded.repartition("row").sortWithinPartitions("row", "k").mapInArrow(joined, "doc_id long, ids binary"))
    return short.unionByName(whole)


_tables: dict[str | None, list[bytes]] = {}


def _token_bytes(path: str | None) -> list[bytes]:
    if path not in _tables:
        ranks = load_ranks(path)
        out = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        _tables[path] = out
    return _tables[path]


def decode_bpe(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` with a column bytes: the raw bytes of all ids, concatenated. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(path).__getitem__
        for b in slices(batches):
            raw = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
