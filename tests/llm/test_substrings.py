"""Repeated passages against brute force, over several tasks."""

import random
import re

import pytest

from gridframe.llm import substrings


def brute(rows, window):
    first, words = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(repr, out))


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        rows.append((rng.randrange(1000) if d % 5 else d, rng.choice([" ", "\n", "  "]).join(words)))
    return [*rows, (None, rows[0][1]), (None, None), (2000, None), (2001, ""), (2002, "Same " * 100), (2003, "Same " * 100), (5, rows[7][1]), (5, rows[8][1])]


@pytest.mark.parametrize("seed, parts, window", [(1, 1, 13), (2, 9, 13), (3, 4, 5), (4, 30, 8)])
def test_equals_brute_force(spark, seed, parts, window):
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, kept string").repartition(parts)
    got = sorted(repr(tuple(r)) for r in substrings.remove_repeats(frame, window).collect())
    assert got == brute(rows, window)


def test_pipeline_form_and_empty_table(spark):
    text = " ".join(f"t{k}" for k in range(30))
    frame = spark.createDataFrame([(1, text, "en", 90), (2, f"before {text} after", "en", 103), (3, None, None, None), (4, " keeps  blanks ", "de", 15)], "doc_id bigint, text string, lang string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["lang"], r["n_chars"]) for r in substrings.deduplicated(frame).collect()}
    assert got == {1: (text, "en", 90), 2: ("before after", "en", 12), 3: (None, None, None), 4: (" keeps  blanks ", "de", 15)}
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_texts(spark):
    text, other = (" ".join(f"{x}{k}" for k in range(30)) for x in "tu")
    rows = [(1, text), (2, f" before\t{text}\n"), (2, other), (2, f"after {text}"), (None, text), (None, f"x {text}"), (3, f"{text}  {text} z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(repr(tuple(r)) for r in substrings.deduplicated(frame).collect())
    assert got == sorted(map(repr, [(1, text), (2, "before"), (2, other), (2, "after"), (None, text), (None, f"x {text}"), (3, "z")]))
