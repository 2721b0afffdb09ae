from __future__ import annotations

import hashlib
import random
import re
import secrets
import string

from factorloom.llm import secret_scan as S

SF = "/root/testdata/sf0.001"
HEX = "9f86d081884c7d659a2feaa0c55ad015"


def slow_base(text):
    """[(start, kind's place, stop)] with the patterns as they are."""
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for place, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)), 1):
        out += [(m.start(), place, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'novel')[k]}:{a}:{b}" for a, k, b in spans)


def found(text, known=()):
    return [(x["start"], S.KINDS.index(x["kind"]), x["stop"]) for x in S.found_in(text, S.Meter(list(known)))]


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "api_", "=", ":", " ", '"', "'", "abcdef012345", "0123456789abcdef", "AKIA", "ABCD1234EFGH5678", "x.y-z/", "\n", "é", "ſecret", "apiKey", "toKen"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        got = [x for x in found(text) if x[1] < 3]
        assert got == slow_base(text), repr(text)


def test_random_strings_are_novel_and_names_are_not():
    r = random.Random(1)
    alphabet = string.ascii_letters + string.digits
    hits = 0
    for _ in range(100):
        key = "".join(r.choice(alphabet) for _ in range(32)) + "7a"
        text = f"# settings\nclient = connect(host, port)\nAuthorization: Bearer {key}\nclient.close()\n"
        hits += (text.index(key), 3, text.index(key) + len(key)) in found(text)
    assert hits == 100
    name = "load_user_settings_v2"
    code = f"def {name}(path):\n    return read(path)\n\nkey = {name}(path)\n"
    assert not found(code)
    assert not found("the key of internationalisation and the session_of_parliament")
    assert not found("auth settings, page 12")
    known = ["connection", "settings", "handler", "database"]
    assert not found("key: connectionhandler1 x", known)
    assert found("password = 0123abcd") == []  # too short


def test_novel_spans_keep_off_base_spans_and_lines():
    text = f"token = {HEX}"
    assert [k for _, k, _ in found(text)] == [0, 2]
    assert not [x for x in found("key\n" + "Zx9" * 9 + "qW") if x[1] == 3]  # another line
    far = "key" + " " * (S.REACH + 1) + "Kq7Zp2Lm9Xc4Vb8N"
    assert not found(far) and found(far.replace(" " * 40, ""))
    r = random.Random(2)
    long = "key " + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(5000))
    assert found(long) == [(4, 3, 5004)]


def test_odd_rows(spark, odd, none):
    assert S.scanned(odd).count() == odd.count() and S.secrets(odd).count() == 0
    assert S.scanned(none).count() == 0 and S.identifiers(none) == []
    rows = [(1, f"see token='{HEX}' there", 5), (None, "AKIA" + "Q7" * 9, None), (2, None, 1), (2, "x " * 50000 + f"key {HEX.upper()}z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = {(r["doc_id"], r["kind"], r["start"], r["stop"]) for r in S.secrets(frame).collect()}
    assert got == {(1, "assign", 4, 43), (1, "hex", 11, 43), (None, "access", 0, 22), (2, "novel", 100004, 100037)}
    clean = S.masked(frame)
    assert clean.columns == frame.columns and [r["text"] for r in clean.collect()] == ["see [secret]' there", "[secret]", None, "x " * 50000 + "key [secret]"]


def test_copies_of_a_secret_stay_out_of_the_dictionary(spark):
    key = "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(40)) + "a1"
    frame = spark.createDataFrame([(i, f"bearer {key} for the client") for i in range(200)], "doc_id long, text string")
    assert not [x for x in S.identifiers(frame) if x in key]
    assert S.secrets(frame).count() == 200


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in S.op12_secret_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    known = S.identifiers(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(got) == len(docs)
    for d in docs:
        base, r = slow_base(d["text"]), got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r["spans"] == joined(found(d["text"], known)) and set(base) <= set(found(d["text"], known))
