"""Substring dedup by hashing units.

Lines are cut further where a sentence ends, as shared passages are often pasted inside a line, and long sentences at
places that the words around them choose, so that a passage is cut the same way whatever stands before and after it in
its sentence. Units are normalised and digested; Spark groups the digests of all documents. The document with the
smallest id, or of several rows with it the first, keeps a unit, at its first place; everywhere else it goes. Adjacent units that go make a span. Spans keep
their places in the original text, and the texts come back without them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, numbered_rows, spare_name, written
from .slices import cuts, sliced

#: Words that a span of op3 has at least. By default every repeated unit goes; but sentences of a word or two ("The.") are
#: in two thirds of otherwise clean documents, so for whole corpora a caller wishes for a minimum.
SPAN_WORDS = 15
#: A sentence of more words is cut where the hash of two adjacent words is the least among those up to REACH places off.
LONG_WORDS, REACH = 16, 3
_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?]+|\n")
_SCHEMA = "rid long, rank long, unit int, again boolean, h1 long, h2 long"
_LAST = (1 << 63) - 1


def _sentences(text: str) -> Iterator[tuple[int, int]]:
    """Lines, cut behind marks that white space or the end of the text follows. Every character is looked at once."""
    start = 0
    for m in _END.finditer(text):
        if m[0] == "\n":
            yield start, m.start()
            start = m.end()
        elif m.end() == len(text) or text[m.end()].isspace():
            yield start, m.end()
            start = m.end()
    yield start, len(text)


def pieces(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, words) of each unit with a word; places are in code points, words are lower-cased."""
    text = text or ""
    for begin, end in _sentences(text):
        words = text[begin:end].lower().split()
        if not words:
            continue
        inner = _cuts(words) if len(words) > LONG_WORDS else []
        ends = [x.end() for x in _WORD.finditer(text, begin, end)] if inner else []
        edges = [begin, *(ends[i - 1] for i in inner), end]
        for a, b, start, stop in zip([0, *inner], [*inner, len(words)], edges, edges[1:]):
            yield start, stop, words[a:b]


def units(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, number of words, digest) of each unit."""
    for start, stop, words in pieces(text):
        yield start, stop, len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def _cuts(words: list[str]) -> list[int]:
    """The numbers of the words that begin a piece. Pieces have more than REACH words; words that recur with a short period are not cut."""
    digest = xxhash.xxh64_intdigest
    h = [digest(f"{a} {b}".encode("utf-8", "replace")) for a, b in zip(words, words[1:])]
    return [i + 1 for i in range(REACH, len(h) - REACH) if h[i] < min(h[i - REACH : i]) and h[i] < min(h[i + 1 : i + 1 + REACH])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2):
        rids, ranks, places, again, digests = [], [], [], [], []
        for rid, rank, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            met, own = set(), [x[3] for x in units(text)]
            for digest in own:
                again.append(digest in met)
                met.add(digest)
            rids += [rid] * len(own)
            ranks += [rank] * len(own)
            places += range(len(own))
            digests += own
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [pa.array(rids, pa.int64()), pa.array(ranks, pa.int64()), pa.array(places, pa.int32()), pa.array(again, pa.bool_()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])


_SPAN = "array<struct<start: int, stop: int, n_words: int, n_units: int, keep_rank: bigint>>"


def _without(span_words: int):
    """A function of texts and of the units that go, as (unit, owner): texts without the spans of enough words, and the spans."""

    def spans(text: str, gone: np.ndarray, owner: np.ndarray) -> list[dict]:
        out: list[dict] = []
        own, last = dict(zip(gone.tolist(), owner.tolist())), -2
        for i, (start, stop, words) in enumerate(pieces(text)):
            if i in own:
                if last < i - 1:
                    out.append({"start": start, "stop": stop, "n_words": 0, "n_units": 0, "keep_rank": own[i]})
                x, last = out[-1], i
                x["stop"], x["n_words"], x["n_units"], x["keep_rank"] = stop, x["n_words"] + len(words), x["n_units"] + 1, min(x["keep_rank"], own[i])
        return [x for x in out if x["n_words"] >= span_words]

    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
        ends, flat = np.cumsum(lengths), gone.flatten()
        unit, owner = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("unit", "owner"))
        found, left = [], []
        for a, b in cuts(texts):
            for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                own = slice(ends[i] - lengths[i], ends[i])
                found.append(spans(text, unit[own], owner[own]) if lengths[i] else [])
                edges = [0, *(x for s in found[-1] for x in (s["start"], s["stop"])), None]
                left.append("".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if found[-1] else text)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()), ("n_units", pa.int32()), ("keep_rank", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(found, kind)], ["text", "spans"])

    return cut


def _rank(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, span_words: int, how: str, rid: str | None = None) -> tuple[DataFrame, str]:
    """docs with a struct of the text that is left and the spans that went (inner: rows with units that go; left: all), and the struct's name."""
    numbered = docs
    if rid is None:
        rid = spare_name(docs, "rid")
        numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    text = F.col(f"`{text_col}`").cast("string")
    cut = written(numbered.select(F.col(rid).alias("rid"), _rank(id_col).alias("rank"), text.alias("text")).mapInArrow(_cut, _SCHEMA), "units")
    # a digest that fills a third of all units is summed before it is dealt out; owners are a table, so that both sides
    # of the join are dealt for it alone and adaptive execution may split such a digest's rows
    owners = cut.where("not again").groupBy("h1", "h2").agg(F.count("*").alias("n_rows"), F.min(F.struct("rank", "rid")).alias("owner")).where("n_rows > 1")
    owners = written(owners.select("h1", "h2", F.col("owner.rank").alias("owner"), F.col("owner.rid").alias("owner_rid")), "owners")
    shared = cut.join(owners, ["h1", "h2"]).where("again or rank > owner or rank = owner and rid > owner_rid").select("rid", "unit", "owner")
    alone = cut.where("again").join(owners, ["h1", "h2"], "left_anti").select("rid", "unit", F.col("rank").alias("owner"))
    gone = shared.union(alone).select("rid", F.struct("unit", "owner").alias("gone"))
    units_gone, told = spare_name(numbered, "gone"), spare_name(numbered, "told")
    by_row = gone.groupBy("rid").agg(F.collect_list("gone").alias(units_gone)).withColumnRenamed("rid", rid)
    # called non-deterministic so that a filter on its result doesn't make Spark run it twice
    without = F.arrow_udf(_without(span_words), f"struct<text: string, spans: {_SPAN}>").asNondeterministic()
    return numbered.join(by_row, rid, how).withColumn(told, without(text, F.col(units_gone))), told


def _spans(told: str, id_col: str) -> Column:
    """Spans with keep_id, the id of the row that keeps them (null if that row has none)."""
    return F.transform(f"{told}.spans", lambda x: F.struct(x["start"], x["stop"], x["n_words"], x["n_units"], F.when(x["keep_rank"] != _LAST, x["keep_rank"]).alias("keep_id")))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 1, rid: str | None = None) -> DataFrame:
    """A row for each document that loses a span: its id, text without its repeated spans, and spans, with start and stop in code points of the original text, n_words, n_units and keep_id, the least id that keeps a unit of it.

    Null and empty texts have no units. Long texts are read whole. Ids are whole numbers; a null id ranks last, and of rows
    that share an id, or have none, the first in the table keeps a unit. Repeats within a row go. Other columns may have
    any names; an empty table gives an empty one. rid: a column of whole numbers that tells rows apart and is the same whenever docs
    is read; without it docs is written with numbers."""
    found, told = _cleaned(docs.select(*[F.col(f"`{c}`") for c in (id_col, text_col, rid) if c]), id_col, text_col, span_words, "inner", rid)
    return found.where(F.size(f"{told}.spans") > 0).select(F.col(f"`{id_col}`"), F.col(f"{told}.text").alias(text_col), _spans(told, id_col).alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 1) -> DataFrame:
    """A row for each span that goes: the id, start, stop, n_words, n_units and keep_id; see ``cleaned``."""
    return cleaned(docs, id_col, text_col, span_words).select(F.col(f"`{id_col}`"), F.explode("spans").alias("span")).select(F.col(f"`{id_col}`"), "span.*")


def without_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 1) -> DataFrame:
    """docs with their repeated spans cut out of the texts; documents without any stay as they are. Columns stay; see ``cleaned``."""
    found, told = _cleaned(docs, id_col, text_col, span_words, "left")
    kept = F.when(F.size(f"{told}.spans") > 0, F.col(f"{told}.text")).otherwise(F.col(f"`{text_col}`"))
    return found.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses a span of SPAN_WORDS or more, without it; see ``cleaned`` for nulls, empty and long texts, repeats and other columns."""
    found = cleaned(numbered_rows(documents(spark, sf_dir).select("doc_id", "text"), "rid"), span_words=SPAN_WORDS, rid="rid")
    return found.select("doc_id", "spans", F.aggregate("spans", F.lit(0), lambda n, x: n + x["n_words"]).alias("words_removed"), "text")
