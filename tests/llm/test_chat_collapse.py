from __future__ import annotations

import random

from factorloom.llm.chat_collapse import maximal, render

SCHEMA = "conv_id long, turn long, role string, text string, pos int, n string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    whole = {c: tuple(x[2:] for x in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, t in whole.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in whole.values()):
            continue
        same = [k for k, o in whole.items() if o == t]
        out[min(same)] = (len(t), len(same), "".join(f"<|{x[1]}|>\n{x[3]}<|end|>\n" for x in t))
    return out


def test_maximal_conversations(spark):
    r = random.Random(7)
    rows = []
    for c in range(300):
        stem = r.randrange(12)
        for k in range(r.randint(1, 6)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", r.choice([f"said {stem} {k}", f"said {stem} {k}", f"said {stem} {k}", None, ""])))
    rows += [(400, 0, None, "x"), (401, 0, "x", None), (402, None, "user", "y"), (403, 0, "user", "a"), (403, 0, "user", "a"), (404, 0, "user", "a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], SCHEMA).repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["chat"]) for r in render(df).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert maximal(df).count() == 0 and render(df).count() == 0


def test_long_conversations_and_turns(spark):
    long = [(1, i, "user" if i % 2 else "bot", f"turn {i} " + "x" * (500_000 if i == 3 else 5)) for i in range(3000)]
    rows = [*long, *[(2, *r[1:]) for r in long[:2500]], *[(3, *r[1:]) for r in long]]
    got = render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"], r["copies"]) for r in got] == [(1, 3000, 2)]
    assert got[0]["chat"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in long)
