"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens the parts into one string in
which each attachment is an ordered placeholder, and records the attachment's reference, its place and the tokens it
will expand to. A template marks the turns; control strings inside texts are escaped so that they can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

#: Tokens that a part without ``n_tokens`` of its own expands to.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}

PARTS = "array<struct<kind:string,text:string,ref:string,n_tokens:int>>"
ATTACHMENTS = "array<struct<ordinal:int,kind:string,ref:string,n_tokens:int,begin:int,end:int>>"
FORMATTED = f"conv_id long, turn long, formatted string, loss_begin int, loss_end int, attachments {ATTACHMENTS}, attachment_tokens long"

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    r"""No ``<|`` is left: ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on."""
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of one turn; ``visit_<kind>`` handles a kind, and kinds without a method become documents.

    Neighbouring texts are escaped as one, since a control string may begin in one and end in the next; ``content`` is
    the turn's text after the last part.
    """

    def __init__(self, default_tokens: dict[str, int]):
        self.default_tokens, self.out, self.size, self.attachments = default_tokens, [], 0, []
        self.texts: list[str] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_document)(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part["text"] or "")

    def put_texts(self) -> None:
        self.put(escape("".join(self.texts)))
        self.texts.clear()

    def content(self) -> str:
        self.put_texts()
        return "".join(self.out)

    def attach(self, kind: str, part: dict) -> None:
        self.put_texts()
        begin, n = self.size, part["n_tokens"] if part["n_tokens"] is not None else self.default_tokens[kind]
        self.put(f"<|{kind}_{len(self.attachments)}|>")
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part["ref"], "n_tokens": n, "begin": begin, "end": self.size})

    def visit_image(self, part: dict) -> None:
        self.attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part)


def format_turns(turns: DataFrame, default_tokens: dict[str, int] | None = None) -> DataFrame:
    """One row per row of ``turns(conv_id, turn, role, text | parts)``: the formatted turn and what is known of it.

    ``loss_begin`` and ``loss_end`` are the code points of the turn's content within ``formatted`` if its role is the
    learned one, else both null. Attachments carry their order, reference, tokens and place. With a column ``parts`` the
    content is that list; else it is the one text. Null texts, roles and lists count as empty; null ids stay null; rows
    that repeat are turns that repeat. Joined in order of turn, the formatted turns are the conversation. No shuffle.
    """
    defaults = DEFAULT_TOKENS | (default_tokens or {})
    content = F.col("parts") if "parts" in turns.columns else F.expr("array(named_struct('kind', 'text', 'text', CAST(text AS STRING), 'ref', CAST(NULL AS STRING), 'n_tokens', CAST(NULL AS INT)))")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), content.cast(PARTS).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            formatted, begins, ends, found, totals = [], [], [], [], []
            for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = Flattener(defaults)
                for part in parts or []:
                    if part is not None:
                        v.visit(part)
                head = f"{START}{escape_role(role or '')}\n"
                formatted.append(f"{head}{v.content()}{END}\n")
                learned = role == LEARNED_ROLE
                begins.append(len(head) if learned else None)
                ends.append(len(head) + v.size if learned else None)
                found.append([a | {"begin": a["begin"] + len(head), "end": a["end"] + len(head)} for a in v.attachments])
                totals.append(sum(a["n_tokens"] for a in v.attachments))
            kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(formatted, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, kind), pa.array(totals, pa.int64())],
                ["conv_id", "turn", "formatted", "loss_begin", "loss_end", "attachments", "attachment_tokens"],
            )

    return rows.mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, unescaped."""
    m = _TURN.fullmatch(formatted)
    return unescape_role(m[1]), unescape(m[2])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns count in order of turn; rows that tie, by their formatted text. A digest follows its text from first to last,
    so a conversation is read by one task, but as a stream of sorted rows: the task holds one turn and two hash states,
    however long the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for conv, text, begin, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != now:
                    if state:
                        done.append((now, *state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = read_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                if begin is not None:
                    learned = unescape(text[begin:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield digests(done)
            done = []
        yield digests([(now, *state)] if state else [])

    def digests(done: list[tuple]) -> pa.RecordBatch:
        conv, n, turns, chars, loss, size = zip(*done, strict=True) if done else ([],) * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in turns], pa.string()), pa.array(chars, pa.int64()), pa.array([x.hexdigest() for x in loss], pa.string()), pa.array(size, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_begin", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
