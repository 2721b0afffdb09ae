"""Secrets in texts: fixed patterns, and strings that a primed compressor has never seen.

Three patterns give the base spans. Beyond them, a run of token characters behind a sensitive word of the same line is a
candidate, and its novelty is what it costs: the bytes by which the surrounding code grows with it, compressed by
zstandard with a dictionary of identifiers. Names, paths and words come out of the surroundings or the dictionary for a
few bytes; random strings pay for every character. What costs more than NOVELTY bytes a character is reported.

The dictionary holds the identifiers that are in the surroundings of most sensitive words of all documents. It is of
fixed size, so it goes to every task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents
from .slices import sliced

#: Kinds in their order: the patterns, and which group of a match must have how many characters. Fixed values.
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: What the method adds.
NOVEL = "novel"
KINDS = [*PATTERNS, NOVEL]
#: Where a match of the first pattern can begin, and the hex pattern's matches that are long enough: a run has no other place to begin.
_ASSIGNED = ("password", "passwd", "secret", "token", "api_key", "apikey")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words, in lower case, that make what follows them in a line, up to REACH characters off, sensitive; and how they begin.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)?|pwd|secret|token|key|auth(?:orization|entication)?|bearer|cred(?:ential)?s?|private|signature|session|salt|nonce|dsn|jwt")
_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "cred", "private", "signature", "session", "salt", "nonce", "dsn", "jwt")
REACH = 64
#: Candidates: runs of so many token characters that hold a letter and a digit.
LEAST = 12
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
_REST = re.compile(r"[A-Za-z0-9+/_-]*={0,2}")
_MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])", re.S)
#: Characters of surroundings on each side, bytes a character above which a candidate is reported, identifiers of the dictionary and zstandard's level (one that looks for the cheapest parse, as pieces of a few letters count).
AROUND, NOVELTY, IDENTIFIERS, LEVEL = 256, 0.5, 4096, 15
#: Identifiers are whole runs of letters; strings with digits could be the secrets themselves.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{3,24}(?![A-Za-z0-9+/_=-])")


def _lowered(text: str) -> str:
    """text with A-Z lowered; places stay."""
    return text.encode("utf-8", "replace").lower().decode()


def _places(lowered: str, stems: tuple[str, ...]) -> list[int]:
    """Where any of the stems begins, in order: plain searches, many times as fast as a pattern of alternatives."""
    found = []
    for stem in stems:
        at = lowered.find(stem)
        while at >= 0:
            found.append(at)
            at = lowered.find(stem, at + 1)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of the patterns' matches that are long enough, by kind; leftmost and non-overlapping within a kind."""
    found, done = [], 0
    pattern, group, least = PATTERNS["assign"]
    for at in _places(_lowered(text), _ASSIGNED):
        if at >= done and (m := pattern.match(text, at)):
            done = m.end()
            if m.end(group) - m.start(group) >= least:
                found.append((at, "assign", done))
    for kind, pattern in (("access", PATTERNS["access"][0]), ("hex", _LONG_HEX)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= PATTERNS[kind][2]]
    return found


def sensitive_words(text: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of sensitive words that no further letter follows."""
    lowered = _lowered(text)
    for at in _places(lowered, _STEMS):
        stop = SENSITIVE.match(lowered, at).end()
        if not "a" <= lowered[stop : stop + 1] <= "z":
            yield at, stop


def candidates(text: str, taken: list[tuple[int, str, int]]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs behind a sensitive word that overlap no span of taken, in order."""
    spans, at, done = sorted((a, b) for a, _, b in taken), 0, 0
    for _, end in sensitive_words(text):
        reach = end + REACH
        line = text.find("\n", end, reach)
        reach = reach if line < 0 else line
        for m in _RUN.finditer(text, max(done, end), reach + LEAST):
            if m.start() >= reach:
                break
            start, stop = m.start(), _REST.match(text, m.end()).end()  # a run that begins within reach counts whole
            done = stop
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            if (at == len(spans) or spans[at][0] >= stop) and _MIXED.match(text[start:stop]):
                yield start, stop


class Meter:
    """Marginal compressed bytes with a dictionary of identifiers."""

    def __init__(self, identifiers: list[str]):
        raw = " ".join(reversed(identifiers)).encode()  # zstandard reaches the end of a dictionary most cheaply
        primed = {}
        if len(raw) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed["dict_data"].precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **primed)

    def marginal(self, text: str, start: int, stop: int) -> int:
        """Bytes by which the surroundings of text[start:stop] grow with it."""
        before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND]
        size = lambda x: len(self.press.compress(x.encode("utf-8", "replace")))
        return size(before + text[start:stop] + after) - size(before + after)


def found_in(text: str | None, meter: Meter, novelty: float = NOVELTY) -> list[dict]:
    """All spans of a text by start, then kind. novelty is null for base spans."""
    text = text or ""
    base = base_spans(text)
    spans = [{"kind": kind, "start": a, "stop": b, "novelty": None} for a, kind, b in base]
    for a, b in candidates(text, base):
        cost = meter.marginal(text, a, b) / (b - a)
        if cost > novelty:
            spans.append({"kind": NOVEL, "start": a, "stop": b, "novelty": cost})
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def _surroundings(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around sensitive words, those that meet as one."""
    start, stop = None, 0
    for a, b in sensitive_words(text):
        a, b = max(0, a - AROUND), min(len(text), b + REACH + AROUND)
        if start is not None and a <= stop:
            stop = b
            continue
        if start is not None:
            yield start, stop
        start, stop = a, b
    if start is not None:
        yield start, stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 0):
        n: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            n.update({m[0] for a, b in _surroundings(text or "") for m in _IDENTIFIER.finditer(text, a, b)})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["identifier", "n"])


def identifiers(docs: DataFrame, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The identifiers around sensitive words by how many texts have them there, the most frequent first: the dictionary's fixed size, counted over all texts."""
    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_counted, "identifier string, n long")
    rows = found.groupBy("identifier").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "identifier").limit(most).collect()
    return [r["identifier"] for r in rows]


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("novelty", T.DoubleType())]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY, known: list[str] | None = None) -> DataFrame:
    """(id, found) of every row: kind, start, stop (code points) and novelty of each span, by start, then kind.

    Base kinds are assign, access and hex; novel spans overlap none of them. Null and empty texts have none; long texts are
    scanned whole. Repeated rows and null ids are rows of their own, other columns are not read, an empty table gives an
    empty one. known: the identifiers of the dictionary; without them they are counted over docs."""
    names = identifiers(docs, text_col) if known is None else known
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("novelty", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(names)
        for batch in sliced(batches, 1):
            found = pa.array([found_in(x, meter, novelty) for x in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "found"])

    return slim.mapInArrow(task, T.StructType([slim.schema["doc_id"], T.StructField("found", _FOUND)]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each span: doc_id, kind, start, stop, novelty."""
    return scanned(docs, id_col, text_col, **options).select("doc_id", F.inline("found"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """docs with every span replaced by the mark; spans that meet are one. Columns stay."""
    names = identifiers(docs, text_col) if options.get("known") is None else options["known"]
    novelty = options.get("novelty", NOVELTY)

    def without(text: str, meter: Meter) -> str:
        out, at = [], 0
        for x in found_in(text, meter, novelty):
            if x["start"] >= at:
                out += [text[at : x["start"]], mark]
            at = max(at, x["stop"])
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        meter = Meter(names)
        return pa.array([None if x is None else without(x, meter) for x in texts.to_pylist()], pa.string())

    return docs.select(*[cut(F.col(f"`{c}`").cast("string")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its numbers and places of secrets; see ``scanned`` for nulls, long texts, repeats and other columns."""
    found = scanned(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != NOVEL)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
