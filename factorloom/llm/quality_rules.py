"""Quality rules as a ledger of failure bits.

Each rule is evaluated once over the measurements of a text and leaves a bit. A policy is a version of the mask of
rules that count: applying one, or asking what each rule of it costs, is arithmetic on the bits and reads no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, written
from .slices import sliced

#: What is measured of a text, in this order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"]
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"

#: A rule's place is its bit; the expression holds where the text fails. Places are never reused.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"),
    ("capitals", "2 * n_capitals > n_letters AND n_letters > 0"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versions of policies; a version is never changed, a new one is added.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
        k = np.uint64(len(number))
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1].astype(np.uint64)
        _, which, times = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        again, covered = times[which] > 1, np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeated = int(covered.sum())
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(np.count_nonzero(codes - np.uint8(65) < 26))
    letters = capitals + int(np.count_nonzero(codes - np.uint8(97) < 26)) + int(np.count_nonzero(codes >= 0xC0))
    return n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capitals, letters


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        rows = np.array([measure(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(MEASURES))]], ["doc_id", *MEASURES])


def bits(rules: list[tuple[str, str]] = RULES) -> Column:
    return sum((F.when(F.expr(said), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, said) in enumerate(rules)), F.lit(0)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the text fails; a row for each row of docs. A null text measures as an empty one.

    Words are what ASCII white space parts. Letters are counted as ASCII letters and characters above U+007F."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in MEASURES]])
    return slim.mapInArrow(_measured, schema).withColumn("failed", bits())


def passes(policy: str | int) -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(book: DataFrame, policy: str | int = "v1") -> DataFrame:
    """For each rule of the policy: the documents that fail it, those that fail nothing else of the policy, and those kept without it. One pass over the bits."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    own = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    used = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    sums = [F.struct(F.lit(name).alias("rule"), count(own.bitwiseAND(F.lit(b).cast("long")) != 0).alias("n_failed"), count(own == b).alias("n_only"), count(own.bitwiseAND(F.lit(mask & ~b).cast("long")) == 0).alias("n_kept_without")) for name, b in used]
    return book.agg(F.array(*sums).alias("each")).select(F.inline("each"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements of every row of documents and what the policies say of it.

    Null texts measure as empty ones, which fail the rules on words; long texts are measured whole. Repeated rows and null
    ids are rows of their own, other columns are not read, an empty table gives an empty one. The ledger is a table, so
    that further policies and ablations read no text."""
    book = written(ledger(documents(spark, sf_dir)), "ledger")
    return book.select(
        "doc_id", *MEASURES[:5], (F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"), passes("v1").alias("kept"), F.col("failed").alias("failed_bits")
    )


_CASES = " + ".join(f"CASE WHEN {said} THEN {1 << i} ELSE 0 END" for i, (_, said) in enumerate(RULES))
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
             length(regexp_replace(text, '[^A-Za-z\\x{{0080}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, ({_CASES})::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (failed & {BASE}) <> 0 AS base_failed, failed = 0 AS kept, failed AS failed_bits FROM b
"""
