"""Token counts and byte-level BPE against the libraries on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridframe.llm import tokens

PARTS = [" ", "\n", "  ", "\t", "\x1c", "\xa0", "a", "bc", "É", " ...", "'s", "12", "<|endoftext|>", "!", "\r\n", "́", "\x85", "語"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(), special_tokens={})
COUNT = tokens.Memo(tokens._counter(None))


def n_tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def ids(text):
    return np.array(RANKS.encode_ordinary(text or ""), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_give_the_library_s_tokens(text):
    cut = tokens.pieces(text)
    assert "".join(cut) == text
    COUNT.learn([cut])
    assert sum(map(COUNT.__getitem__, cut)) == n_tokens(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_marks_are_the_library_s_matches(text):
    at, before, total = tokens.mark_tokens(None)(text)
    assert total == n_tokens(text)
    for p, n in zip(at.tolist(), before.tolist(), strict=True):  # what lies before a mark has that many tokens
        assert n_tokens(text[:p]) == n or text[:p][-1:].isspace()
    if "<|" not in text:
        assert at.tolist() == tokens.mark_matches(None)(text)[0].tolist()


def test_memo_keeps_no_long_piece():
    known = tokens.Memo(lambda new: [len(x) for x in new])
    known.learn([["a" * 1000, "bc"]])
    assert known["a" * 1000] == 1000 and list(known) == ["bc"]
    known.learn([["bc"]])
    with pytest.raises(KeyError):
        known["a" * 1000]


def test_memo_that_starts_anew_knows_all_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    known = tokens.Memo(lambda new: [len(x) for x in new])
    for docs in ([["a", "bb"], ["a"]], [["a", "ccc", "d" * 999]], [["a", "bb", "eeee"], []], [["f", "a"]]):
        assert known.codes(docs) == [list(map(len, d)) for d in docs]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id bigint, text string, n_tokens string, row int")


def counted(spark, rows, **options):
    return sorted(repr(tuple(r)) for r in tokens.count_tokens(docs(spark, rows), **options).collect())


def want(rows):
    return sorted(repr((i, len((t or "").encode()), n_tokens(t), n_tokens(t) > 1024)) for i, t in rows)


def encoded(spark, rows, **options):
    return sorted((repr(r["doc_id"]), bytes(r["ids"]), bytes(r["bytes"])) for r in tokens.decode_bpe(tokens.encode_bpe(docs(spark, rows), **options)).collect())


def want_ids(rows):
    return sorted((repr(i), ids(t), (t or "").encode()) for i, t in rows)


ROWS = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "x y"), (1, "Hello  world\n"), (4, "word " * 40000), (4, "word " * 40000), (5, "<|endoftext|>"), (None, "é\n" * 40000)]


def test_rows(spark):
    assert counted(spark, ROWS) == want(ROWS)
    assert encoded(spark, ROWS) == want_ids(ROWS)
    assert tokens.count_tokens(docs(spark, [])).count() == tokens.encode_bpe(docs(spark, [])).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 60), (150, 40), (40, 90)])
def test_chunks_give_the_whole_text_s_tokens(spark, chunk, overlap):
    rng = random.Random(chunk)
    words = [*PARTS, " the", " internationalisation", "don't", " we're", "   ", "\n\n", " 12345", "....", "aaaa"]
    rows = [(k, "".join(rng.choice(words) for _ in range(rng.randrange(200)))) for k in range(120)]
    rows += [(900, "x" * 1000), (901, " " * 500 + "y" + " " * 500), (902, "<|endoftext|>" * 60), (None, "'re" * 200)]
    assert counted(spark, rows, chunk=chunk, overlap=overlap) == want(rows)
    assert encoded(spark, rows, chunk=chunk, overlap=overlap) == want_ids(rows)


def test_a_wrong_splice_would_change_the_count(spark):
    """Chunks laid end to end, or spliced where only one of them has a boundary, cut words in two and count more."""
    text = " internationalisation" * 40
    assert sum(n_tokens(text[k : k + 100]) for k in range(0, len(text), 100)) > n_tokens(text)
    at, other = (tokens.mark_tokens(None)(text[a:b])[0] + a for a, b in ((0, 164), (100, 264)))
    assert other[0] not in at
    assert tokens.meeting(at[at < 164 - tokens.MARGIN_CHARS], other, 101) in set(at.tolist()) & set(other.tolist())
    assert tokens.meeting(np.array([110, 120]), np.array([110, 115, 120]), 101) is None  # they part again: no proof
    assert counted(spark, [(1, text)], chunk=100, overlap=64) == want([(1, text)])


def test_failed_alignment_widens_the_overlap(spark):
    """No match begins inside the first overlaps: rounds double them until one does."""
    text = "word " * 30 + "a" * 700 + " word" * 30
    long = spark.createDataFrame([(1, 7, text)], "row bigint, doc_id bigint, text string")
    parts = tokens.resynchronised(long, lambda: tokens.mark_matches(None), 200, 50, lambda df: df).collect()
    assert {r["overlap"] for r in parts} == {800} and sum(r["n"] for r in parts) == len(list(tokens._pattern().finditer(text)))
    begins = sorted((r["begin"], r["end"]) for r in parts if r["begin"] != r["end"])
    assert [b for b, _ in begins[1:]] == [e for _, e in begins[:-1]] and begins[0][0] == 0 and begins[-1][1] == -1
