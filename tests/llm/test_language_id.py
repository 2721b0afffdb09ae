from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np

from factorloom.llm import language_id as L

PARTS = {"xx": ["ba", "bo", "ti", "ra"], "yy": ["schu", "gre", "ung", "ö"], "zz": ["дом", "река", "лес", "мир"]}


def made(n=300):
    r = random.Random(4)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        rows.append((i, " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.predict(docs.withColumn("held_out", L.held_out(docs["doc_id"])), L.learn(L.training_rows(docs)), ["doc_id", "lang", "held_out"]).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 30 and sum(r["lang"] == r["lang_pred"] for r in out) > 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prototypes_are_the_bundles_of_all_training_texts(spark):
    rows = made(60)
    learned = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7))
    for lang in PARTS:
        total = np.zeros(L.DIMENSIONS)
        for _, text, own in rows:
            if own == lang:
                codes, counts = L.trigrams(text)
                total += counts @ L.trigram_vectors(codes, L.DIMENSIONS).astype(float)
        assert np.allclose(learned[lang], total / np.linalg.norm(total), atol=1e-6)


def test_kept_vectors_do_not_change_bundles():
    codes, counts = L.trigrams("many different words make many trigrams indeed")
    small, large = L._Vectors(128, kept=8), L._Vectors(128)
    other = L.trigrams("other words before")
    large.bundles(other[0], other[1][None])
    assert (small.bundles(codes, counts[None]) == large.bundles(codes, counts[None])).all()
    huge = large.bundles(codes, counts[None] * (1 << 40))  # whole numbers beyond single precision
    assert (huge == large.bundles(codes, counts[None]) * (1 << 40)).all()


def slow_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out if any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()) else []


def slow_prediction(text, prototypes):
    """Letter by letter and language by language."""
    shown = "".join(f" {w}" for w in slow_words(text)) + " "
    if len(shown) < 3 or not prototypes:
        return "und", 0.0
    letter = {c: L.letter_vectors(np.array([ord(c)], np.uint64), L.DIMENSIONS)[0].astype(int) for c in set(shown)}
    total = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(shown, shown[1:], shown[2:]))
    cosine = {k: float(v @ total / np.linalg.norm(total)) for k, v in sorted(prototypes.items())}
    best = max(cosine, key=cosine.get)
    return best, min(1.0, max(0.0, cosine[best]))


def test_predictions_are_those_of_plain_loops(spark, odd):
    rows = [(i, t) for i, (_, t, _) in enumerate(made(40))] + [(100 + i, t) for i, t in enumerate(["½²①", "Ⅷ", "Ⅷ a", "e\u0301te\u0301 x", "\u0301", "", None, "a", "ÅÉ·x_y9z", "12 !", "İstanbul"])]
    rows += [(200 + i, r["text"]) for i, r in enumerate(odd.collect())]
    prototypes = L.learn(spark.createDataFrame(made(80), "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), prototypes, ["doc_id"]).collect()}
    for i, text in rows:
        lang, score = slow_prediction(text, prototypes)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-9, repr(text)
    assert [got[100 + i]["lang_pred"] for i in (0, 1, 4, 5, 6, 9)] == ["und"] * 6 and got[102]["lang_pred"] != "und"


def test_ties_go_to_the_first_name_and_blocks_of_languages_agree(spark, monkeypatch):
    docs = spark.createDataFrame(made(40), "doc_id long, text string, lang string")
    one = L.learn(docs)
    tied = {"zz": one["xx"], "mm": one["xx"], "aa": one["xx"]}
    assert {r["lang_pred"] for r in L.predict(docs, tied, ["doc_id"]).collect()} == {"aa"}
    told = lambda: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in L.predict(docs, one, ["doc_id"]).collect())
    whole = told()
    monkeypatch.setattr(L, "BLOCK", 1)
    assert told() == whole
    assert {r["lang_pred"] for r in L.predict(docs, tied, ["doc_id"]).collect()} == {"aa"}


def test_odd_rows(spark, odd, none):
    prototypes = L.learn(L.training_rows(odd))
    got = L.predict(odd, prototypes, ["doc_id", "n_chars"]).collect()
    assert len(got) == odd.count()
    kept = L.recognised(odd)
    assert kept.columns == odd.columns
    assert {r["text"] for r in kept.collect()} == {r["text"] for r in odd.collect() if slow_prediction(r["text"], prototypes)[1] >= L.CHANCE}
    assert L.recognised(none).count() == 0
    unlearned = L.predict(odd, L.learn(L.training_rows(none)), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearned} == {("und", 0.0)}
    nothing = L.recognised(odd.where("lang is null or text = ''")).collect()  # no language to learn: letters decide
    assert {r["text"] for r in nothing} == {r["text"] for r in odd.where("lang is null or text = ''").collect() if slow_words(r["text"])}


def test_the_query_over_a_table(spark):
    """Held-out accuracy on the given documents, and all rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = L.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    checked = [r for r in got if r["held_out"] and rows[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(checked) > 100 and sum(rows[r["doc_id"]]["lang"] == r["lang_pred"] for r in checked) >= 0.98 * len(checked)
