from __future__ import annotations

import random
import re
from collections import Counter

from factorloom.llm import license_scan as L
from factorloom.llm.license_scan import TEMPLATES, Scanner, licenses


def dice(a, b):
    grams = [Counter(zip(w, w[1:])) for w in (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))]
    return 2 * sum((grams[0] & grams[1]).values()) / max(1, sum(map(lambda g: sum(g.values()), grams)))


def test_found_windows_have_the_coefficient_they_claim():
    scanner = Scanner()
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"Words before İ, {text.upper()} words behind.\nNone here.")
        assert name in {x[0] for x in found} or any(x[1] == 1.0 for x in found), (name, found)
    text = "Some prose. Licensed&&& under*** the### Apache&&& License, Version 2.0 and all the rights reserved. All rights reserved."
    found = scanner.scan(text)
    assert {"Apache-2.0-notice", "all-rights-reserved"} <= {x[0] for x in found}
    for name, d, start, stop in found:
        assert d >= 0.8 and abs(dice(TEMPLATES[name], text[start:stop]) - d) < 1e-12


def test_best_windows_are_those_of_brute_force():
    scanner = Scanner({"t": "one two three four five six"})
    words = "zero one two three x five six one two three four five six seven one two".split()
    best = max(dice("one two three four five six", " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 2, len(words) + 1))
    assert scanner.scan(" ".join(words))[0][1] == best == 1.0


def test_odd_rows(spark, odd, none):
    assert {(r["doc_id"], r["license_id"]) for r in licenses(odd).collect()} == {(None, "MIT-notice")}
    assert licenses(none).count() == 0
    assert licenses(spark.createDataFrame([(1, "a licence of none " * 5000)], "doc_id long, text string")).count() == 0


def slow_scan(text, templates, threshold):
    """Every window of words against every template; disjoint ones, the best first."""
    words = [(m[0], m.span()) for m in re.finditer(r"[^\W_]+", text.lower())]
    pairs = [(a, b) for (a, _), (b, _) in zip(words, words[1:])]
    found = []
    for name, body in templates.items():
        own = re.findall(r"[^\W_]+", body.lower())
        grams = Counter(zip(own, own[1:]))
        for i in range(len(pairs)):
            for j in range(i, min(len(pairs), i + 3 * sum(grams.values()))):
                window = Counter(pairs[i : j + 1])
                dice = 2 * sum((window & grams).values()) / (sum(window.values()) + sum(grams.values()))
                if dice >= threshold - 1e-12:
                    found.append((-dice, i - j, i, name, j))
    taken, out = set(), []
    for minus, _, i, name, j in sorted(found):
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((name, -minus, words[i][1][0], words[j + 1][1][1]))
    return out


def test_windows_are_those_of_brute_force():
    r = random.Random(3)
    short = {k: v for k, v in L.TEMPLATES.items() if len(v) < 90}
    scanner = L.Scanner(short)
    parts = [w for v in short.values() for w in v.split()] + ["some", "other", "words"]
    for _ in range(150):
        text = []
        for _ in range(r.randint(1, 4)):
            body = r.choice(list(short.values())).split()
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(body))
                body[k : k + r.randint(0, 1)] = [r.choice(parts)]
            text += body + r.choices(parts, k=r.randint(0, 3))
        text = " ".join(text)
        assert scanner.scan(text) == slow_scan(text, short, L.THRESHOLD), text


def test_ties_go_to_the_longer_then_the_earlier_then_the_name():
    twins = {"b": "one two three four", "a": "one two three four"}
    assert [x[0] for x in L.Scanner(twins).scan("One, two, three, four; one two three four")] == ["a", "a"]
    assert L.Scanner(twins).scan("x one two three four y one two three four")[0][2] == 2


def test_licences_that_differ_in_a_clause_are_told_apart():
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Zlib", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0-header", "Unlicense", "CC0-1.0", "CC-BY-4.0-notice", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-notice"):
        text = "Copyright (c) 2020 Somebody Else\n\n" + L.TEMPLATES[name].replace(". ", ".\n * ") + "\nint main() { return 0; }"
        found = L.Scanner().scan(text)
        assert found[0][0] == name and found[0][1] > 0.95, (name, found)
