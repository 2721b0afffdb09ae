from __future__ import annotations

import random
import re

import pytest

from factorloom.llm import quality_rules as Q

SPACES = r"[\x20\x09-\x0D]"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def texts():
    r = random.Random(8)
    parts = ["a", "b", "Word", "é#", "x|y", "\n", "\n\n", " ", "\t", "a b c ", "same line\n", "\x0b", "日本", "."]
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", " ", "a b c a b c", "a a a a"]


def test_measures():
    for text in texts():
        assert Q.measure(text)[:5] == slow(text), repr(text)


def test_ledger_policies_and_ablations(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None)]
    book = Q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    got = book.collect()
    assert len(got) == len(rows)
    mask = Q.POLICIES["v1"]
    for r in Q.ablations(book).collect():
        bit = Q.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in got)
        assert r["n_only"] == sum(x["failed"] & mask == bit for x in got)
        assert r["n_kept_without"] == sum(not x["failed"] & mask & ~bit for x in got)
    assert book.where(Q.passes("base")).count() == sum(not (n < 50 or 100 * rep > 50 * n) for n, _, _, _, rep in (slow(t) for _, t in rows))
    assert Q.ledger(odd).count() == odd.count() and Q.ledger(none).count() == 0
    assert [r["n_failed"] for r in Q.ablations(Q.ledger(none)).collect()] == [0] * len(Q.RULES)


@pytest.mark.parametrize("text,rule", [("W" * 3 + " word" * 60, None), ("GOOD LOUD WORDS " * 30, "capitals"), ("a&&& " * 60, "many_symbols"), ("1 2 3 4 5 6 7 8 9 " * 10, "few_letters")])
def test_rules(spark, text, rule):
    failed = Q.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["failed"]
    assert rule is None or failed & Q.BIT[rule]
