from __future__ import annotations

import random
import time

import pytest
import xxhash

from factorloom.llm import line_dedup as L


def slow_units(text):
    """(start, stop, words) character by character, by the rules as the docstrings state them."""
    text, out = text or "", []
    places, begin, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            places.append((begin, i))
            begin = i + 1
        elif text[i] in ".!?" and (i + 1 == len(text) or text[i + 1].isspace()):
            places.append((begin, i + 1))
            begin = i + 1 if i + 1 == len(text) or text[i + 1] != "\n" else i + 2
            i = begin - 1
        i += 1
    places.append((begin, len(text)))
    for begin, stop in places:
        found, at = [], None  # (word, its end)
        for i in range(begin, stop + 1):
            if i < stop and not text[i].isspace():
                at = i if at is None else at
            elif at is not None:
                found.append((text[at:i].lower(), i))
                at = None
        words = [w for w, _ in found]
        cut = []
        if len(words) > L.LONG_WORDS:
            h = [xxhash.xxh64_intdigest(f"{x} {y}".encode()) for x, y in zip(words, words[1:])]
            cut = [i + 1 for i in range(L.REACH, len(h) - L.REACH) if all(h[i] < h[k] for k in range(i - L.REACH, i + L.REACH + 1) if k != i)]
        edges = [0, *cut, len(words)]
        for x, y in zip(edges, edges[1:]):
            if words:
                out.append((begin if not x else found[x - 1][1], stop if y == len(words) else found[y - 1][1], words[x:y]))
    return out


def brute(rows, span_words):
    """Owners by a dictionary over all units; rows: (id, text)."""
    each = [(i, (i is None, i or 0, n), [(a, b, len(w), " ".join(w)) for a, b, w in slow_units(t)]) for n, (i, t) in enumerate(rows)]
    owner, docs = {}, {}
    for n, (i, rank, us) in enumerate(each):
        for *_, d in us:
            docs.setdefault(d, set()).add(n)
            owner[d] = min(owner.get(d, rank), rank)
    out = []
    for i, rank, us in each:
        met, run = set(), []
        for start, stop, n, d in [*us, (0, 0, 0, None)]:
            if d is not None and (d in met or (len(docs[d]) > 1 and rank > owner[d])):
                run.append((start, stop, n))
            else:
                if sum(x[2] for x in run) >= span_words:
                    out.append((repr(i), run[0][0], run[-1][1], sum(x[2] for x in run), len(run)))
                run = []
            met.add(d)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \n\n ", "a", "A b.\nc. d?! e", "a...b ... c..", ".\n.", "x.\n", "1.5 and 2.\u00a0Ä\x1c. End", "one two " * 30, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20.  Next\tone"])
def test_units(text):
    assert [(a, b, w) for a, b, w in L.pieces(text)] == slow_units(text)


def test_long_runs_of_stops_take_no_longer():
    for text in ("a" + "." * 1_000_000 + "x", "." * 1_000_000, ("a" * 50 + ".") * 20_000, "\n" * 1_000_000):
        began = time.perf_counter()
        assert len(list(L.units(text))) <= 1
        assert time.perf_counter() - began < 5


def spans(df, **k):
    return sorted((repr(r["doc_id"]), r["start"], r["stop"], r["n_words"], r["n_units"]) for r in L.repeated_spans(df, **k).collect())


def test_spans_are_those_of_brute_force(spark):
    r = random.Random(6)
    sentences = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "?!", ""]) for _ in range(40)]
    rows = [(i, "".join(r.choice(sentences) + r.choice([" ", "\n", " \n\n"]) for _ in range(r.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (1, 15):
        assert spans(df, span_words=least) == brute(rows, least)


def test_rows_of_one_id_or_without_take_units_from_each_other(spark):
    line = "The same line of more than a few words is here again and again"
    rows = [(1, line), (1, line + "\nbut this is not"), (None, "No id has this line of its own"), (None, "No id has this line of its own"), (2, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans(df) == brute(rows, 1)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in L.cleaned(df).collect()) == [("1", "\nbut this is not"), ("2", ""), ("None", "")]


def test_a_passage_inside_lines_is_found_and_cut(spark):
    passage = " ".join(f"Sentence number {i} says its own word w{i} here and now." for i in range(8))
    rows = [(1, "first text " + passage + " tail one"), (2, "clean text. It has its own words only."), (3, "other words\nbefore " + passage + "\nand behind")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (r,) = L.repeated_spans(df, span_words=15).collect()
    assert (r["doc_id"], r["keep_id"]) == (3, 1) and r["n_words"] > 60 and rows[2][1][r["start"] : r["stop"]].strip().startswith("Sentence number 1")
    cut = {r["doc_id"]: r["text"] for r in L.without_spans(df, span_words=15).collect()}
    (told,) = L.cleaned(df, span_words=15).collect()
    assert told["doc_id"] == 3 and told["text"] == cut[3] and [tuple(x)[:2] for x in told["spans"]] == [(r["start"], r["stop"])]
    assert cut[1] == rows[0][1] and cut[2] == rows[1][1] and "number 5" not in cut[3] and cut[3].startswith("other words\nbefore") and cut[3].endswith("\nand behind")


def without(text, spans):
    for start, stop in sorted(spans, reverse=True):
        text = text[:start] + text[stop:]
    return text


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for least in (1, L.SPAN_WORDS):
        want = brute(rows, least)
        assert spans(odd, span_words=least) == want
        cut = L.without_spans(odd, span_words=least)
        assert cut.columns == odd.columns and cut.count() == odd.count()
        by_id = {}
        for i, start, stop, *_ in want:
            by_id.setdefault(i, []).append((start, stop))
        lost = L.cleaned(odd, span_words=least).collect()
        texts = {(repr(i), t) for i, t in rows}
        assert {repr(r["doc_id"]) for r in lost} == set(by_id)
        for r in lost:
            places = [(x["start"], x["stop"]) for x in r["spans"]]
            assert any(i == repr(r["doc_id"]) and t is not None and without(t, places) == r["text"] for i, t in texts)
        assert sorted(repr(r["text"]) for r in cut.collect() if r["doc_id"] == 4) == ["None"]
    for f in (L.repeated_spans, L.without_spans, L.cleaned):
        assert f(none).count() == 0


def test_the_query_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    got = L.op3_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((repr(r["doc_id"]), *list(x)[:4]) for r in got for x in r["spans"]) == brute(rows, L.SPAN_WORDS)
    texts = dict(rows)
    for r in got:
        assert r["text"] == without(texts[r["doc_id"]], [(x["start"], x["stop"]) for x in r["spans"]])
        assert r["words_removed"] == sum(x["n_words"] for x in r["spans"])


def test_a_passage_inside_one_long_sentence_is_found(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(9)} {passage} {words(30)}."), (2, f"{words(40)}  {passage}\t{words(5)}"), (3, words(200)), (4, passage)]
    found = {k: [r for r in L.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), span_words=5).collect() if r["doc_id"] == k] for k in range(1, 5)}
    assert not found[1] and not found[3]
    for k in (2, 4):
        (r,) = found[k]
        cut = rows[k - 1][1][r["start"] : r["stop"]]
        assert r["keep_id"] == 1 and " ".join(cut.split()) in passage and r["n_words"] == len(cut.split()) > 40
    junk = "x y " * 5000
    assert len(list(L.units(junk))) == 1
