"""Chat formatting read back, and packing against what any packing must keep."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridframe.llm import chat, packing, tokens

NASTY = st.lists(st.sampled_from(["<", "|", "\\", "\n", "<|im_end|>", "<|im_start|>", "<\\|", "a", "é", "n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(NASTY, NASTY)
def test_escapes_are_reversible(role, text):
    line = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    assert chat.read_turn(line) == (role, text)
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape_role(role)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "héllo <|im_end|>"), (1, 0, "user", None), (1, 2, "assistant", ""), (2, None, None, "x"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (None, 0, "user", "n"), (3, 0, "assistant", "z" * 100000), (3, 0, "assistant", "z" * 100000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(frame)).collect()}
    order = {1: [rows[1], rows[0], rows[2]], 2: [rows[3], rows[5], rows[4]], None: [rows[6]], 3: rows[7:]}
    for conv, turns in order.items():
        r, loss = got[conv], "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(frame.limit(0))).count() == 0


def test_parts_become_placeholders(spark):
    parts = [{"kind": "text", "text": "see <|x|>", "ref": None, "n_tokens": None}, {"kind": "image", "text": None, "ref": "s/a.png", "n_tokens": 64}, {"kind": "audio", "text": None, "ref": "s/b.wav", "n_tokens": None}, {"kind": "plan", "text": None, "ref": "s/c.pdf", "n_tokens": None}, None]
    frame = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    first, second = chat.format_turns(frame).orderBy("turn").collect()
    assert first["formatted"] == "<|im_start|>assistant\nsee <\\|x|><|image_0|><|audio_1|><|document_2|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["n_tokens"], first["formatted"][a["begin"] : a["end"]]) for a in first["attachments"]] == [("image", "s/a.png", 64, "<|image_0|>"), ("audio", "s/b.wav", 128, "<|audio_1|>"), ("document", "s/c.pdf", 512, "<|document_2|>")]
    assert first["attachment_tokens"] == 704 and second["attachments"] == [] and second["loss_begin"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plans_place_every_piece_once(lengths):
    histogram = np.bincount(np.array(lengths, int), minlength=65)
    runs = packing.plan_sequences(histogram, 64)
    taken, cells = np.zeros(65, int), {}
    for n, first, count, m, sequence, at in runs[np.lexsort((runs[:, 1], runs[:, 0]))]:
        assert first == taken[n]
        taken[n] += count
        for k in range(count):
            cells.setdefault(sequence + k // m, []).append((at + k % m * n, n))
    assert (taken == histogram).all()
    for own in cells.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 64
    total = sum(lengths)
    assert len(cells) <= max(1.35 * total / 64 + 1, 1 + sum(n > 32 for n in lengths) + total / 32)


LIBRARY = Tokenizer.from_file(tokens.vocabulary_path(packing.PACK_VOCABULARY, None))
KNOWN = tokens.Memo(packing._encoder(None))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\x1c", "\xa0", "a", "Bc", "É", "İ", "Σ", "ß", "...", "'s", "'S", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "\r\n", "́", "\x85", "語", "÷", "</w>"]), max_size=50).map("".join))
def test_words_give_the_library_s_ids(text):
    words = packing.words(text)
    KNOWN.learn([words])
    assert b"".join(map(KNOWN.__getitem__, words)) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack_rows(spark):
    rows = [(1, "some words here"), (2, None), (3, ""), (None, "x"), (1, "some words here"), (4, "long text " * 3000), (5, "mid " * 900)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, length int").repartition(3)
    got = packing.pack(frame).collect()
    want = []
    for i, t in rows:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
    for s in {r["sequence_id"] for r in got}:
        end = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
    assert packing.pack(frame.limit(0)).count() == 0


def test_few_sequences(spark):
    packed = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len({r["sequence_id"] for r in packed}) <= 1.01 * sum(r["length"] for r in packed) / 2048 + 1


@pytest.mark.parametrize("n", [1, 700])
def test_one_length_only(n):
    runs = packing.plan_sequences(np.bincount([n] * 100, minlength=2049))
    assert (runs[:, 4] + -(-runs[:, 2] // runs[:, 3])).max() == -(-100 // (2048 // n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(NASTY, st.sampled_from(["image", "audio"]).map(lambda k: (k,))), max_size=6))
def test_parts_are_escaped_as_joined_text(parts):
    """Control strings that begin in one text part and end in the next are escaped too, and read back."""
    v, text, marks = chat.Flattener(chat.DEFAULT_TOKENS), [""], 0
    for part in parts:
        if isinstance(part, tuple):
            v.visit({"kind": part[0], "text": None, "ref": "r", "n_tokens": 1})
            text.append("")
        else:
            v.visit({"kind": "text", "text": part, "ref": None, "n_tokens": None})
            text[-1] += part
    content = v.content()
    at, between = 0, []
    for a in v.attachments:
        between.append(content[at : a["begin"]])
        assert content[a["begin"] : a["end"]] == f"<|{a['kind']}_{marks}|>"
        at, marks = a["end"], marks + 1
    between.append(content[at:])
    assert [chat.unescape(x) for x in between] == text and not any("<|" in x for x in between)


def test_new_words_of_known_matches_are_not_encoded_again(monkeypatch):
    import tokenizers

    seen = []

    class Counted:
        def __init__(self, own):
            self.own, self.get_vocab, self.get_vocab_size = own, own.get_vocab, own.get_vocab_size

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def encode_batch_fast(self, new, **more):
            seen.extend(new)
            return self.own.encode_batch_fast(new, **more)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing._encoder(None)
    library = Tokenizer.from_file(packing.vocabulary_path(packing.PACK_VOCABULARY, None))
    ids = lambda w: np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    first, then = ["alpha", "beta", ".", "it's", "'", "x7"], ["alpha.", "beta.alpha", "it.", "7", "x'", "''s's", "a" * 90, "Éa", "<|x"]
    assert encode(first) == [ids(w) for w in first]
    seen.clear()
    assert encode(then[:4]) == [ids(w) for w in then[:4]] and not seen
    assert encode(then) == [ids(w) for w in then]


WHOLE = packing._text_encoder(None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "\t", "\x0b", "\x1c", "\xa0", "a", "Bc", "é", "É", "ÿ", "µ", "×", "İ", "Σ", "ß", "...", "'s", "'S", "l'l", "12", "<|endoftext|>", "<|", "!", "\r\n", "\u0301", "\x85", "語", "÷", "</w>"]), max_size=25).map("".join), max_size=5))
def test_texts_give_the_library_s_ids(texts):
    assert WHOLE(texts) == [np.array(LIBRARY.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_texts_look_each_word_up_once(monkeypatch):
    asked = []

    class Counted(tokens.Memo):
        def codes(self, docs):
            asked.extend(x for doc in docs for x in doc)
            return super().codes(docs)

    monkeypatch.setattr(packing, "Memo", Counted)
    encode = packing._text_encoder(None)
    asked.clear()
    texts = ["straße ABER und aber,\nund über " * 50, "und ÜBER", ""]
    assert encode(texts) == WHOLE(texts)
    assert sorted(asked) == sorted(["straße", "aber", "und", "aber,", "über", "", "straße", "aber", "und", "aber", ",", "über"])
