"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. Rotating the vectors of three adjacent
letters by two, one and no places and multiplying them binds a trigram; adding trigrams bundles a text. A language's
prototype bundles all its training texts, and a text gets the language whose prototype is nearest by cosine.

Prototypes are learned from all training rows: Spark counts trigrams by language, then bundles the counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, spare_name, written
from .slices import cuts, sliced
from .sums import summed_arrays

DIMENSIONS = 512
#: Languages whose prototypes go to the tasks together; more languages are compared block by block.
BLOCK = 1024
#: Trigram vectors that a task keeps; they are made anew when more turn up.
KEPT_TRIGRAMS = 1 << 14
UNKNOWN = "und"
#: A cosine of random vectors has a deviation of 1 / sqrt(DIMENSIONS); below three of them a text is like no language.
CHANCE = 3 / DIMENSIONS**0.5

_SPACE = 32
#: Texts that are bundled together, and their bytes.
_TEXTS, _BYTES = 64, 1 << 17


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters (Unicode categories L*), 1 for marks (M*), which belong to the letters before them, else 0."""
    kind = {"L": 2, "M": 1}
    return np.frombuffer(bytes(kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words, each between single spaces; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    kind = _kinds()[points]
    if not (kind == 2).any():
        return np.empty(0, np.uint64)
    inside = kind > 0
    first = np.r_[False, inside[:-1]]  # of several separators the first stands for all
    out = np.where(inside, points, _SPACE)[inside | first].astype(np.uint64)
    return np.r_[np.uint64(_SPACE), out, np.full(int(inside[-1]), _SPACE, np.uint64)]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of all texts, sorted, and how often each text has each."""
    parts = [letters(x) for x in texts]
    flat, own = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    if len(flat) < 3:
        return np.empty(0, np.uint64), np.zeros((len(parts), 0), np.int64)
    within = own[:-2] == own[2:]
    codes = (flat[:-2] << np.uint64(42) | flat[1:-1] << np.uint64(21) | flat[2:])[within]
    known, which = np.unique(codes, return_inverse=True)
    return known, np.bincount(own[:-2][within] * len(known) + which, minlength=len(parts) * len(known)).reshape(len(parts), len(known))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of a text and their counts; none without a letter."""
    codes, counts = counted([text])
    return codes, counts[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    lanes = np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = _mixed(points[:, None] * np.uint64(0xD1342543DE82EF95) + lanes[None, :])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    mask = np.uint64((1 << 21) - 1)
    bound = np.ones((len(codes), dimensions), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        points, which = np.unique(codes >> np.uint64(shift) & mask, return_inverse=True)
        bound *= np.roll(letter_vectors(points, dimensions), turn, axis=1)[which]
    return bound


class _Vectors:
    """Trigram vectors, with those of the trigrams met before at hand."""

    def __init__(self, dimensions: int, kept: int = KEPT_TRIGRAMS):
        self.dimensions, self.kept = dimensions, kept
        self.codes, self.rows = np.empty(0, np.uint64), np.empty((0, dimensions), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """codes: sorted and distinct, as many as fit."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = codes[~known]
            if len(self.codes) + len(new) > self.kept:
                self.codes, self.rows, new = self.codes[:0], self.rows[:0], codes
            where = np.searchsorted(self.codes, new)
            self.rows = np.insert(self.rows, where, trigram_vectors(new, self.dimensions), axis=0)
            self.codes = np.insert(self.codes, where, new)
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def bundles(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row for each row of counts. Sums are whole numbers and exact: in single precision up to 2^24, else in double."""
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        total = np.zeros((len(counts), self.dimensions), kind)
        for i in range(0, len(codes), 4096):
            total += counts[:, i : i + 4096].astype(kind) @ self.of(codes[i : i + 4096]).astype(kind)
        return total.astype(np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, summed over what a task has read."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return codes, np.bincount(which, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])

    pending = 0
    for batch in sliced(batches, "text", _BYTES):
        by_lang: dict[str, list] = {}
        for lang, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "text"))):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for i in range(0, len(texts), _TEXTS):
                codes, counts = counted(texts[i : i + _TEXTS])
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts.sum(axis=0)))
                    pending += len(codes)
        if pending > 1 << 19:
            held = {x: [merged(parts)] for x, parts in held.items()}
            pending = 0
            if sum(len(x[0][0]) for x in held.values()) > 1 << 19:
                yield from out()
                held = {}
    yield from out()


def _bundle(dimensions: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = _Vectors(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            codes, counts = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("code", "n"))
            for lang in dict.fromkeys(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                own = own[np.argsort(codes[own].view(np.uint64))]
                total[lang] = total.get(lang, 0) + vectors.bundles(codes[own].view(np.uint64), counts[None, own])[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    return task


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each language, of length 1. Rows without a text, letters or language teach nothing.

    To the driver comes one row of fixed length for each language."""
    slim = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = slim.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = written(counts.mapInArrow(_bundle(dimensions), "lang string, vector array<double>"), "bundles")
    vectors = {lang: v for (lang,), v in sorted(summed_arrays(parts, ["lang"], "vector").items())}
    return {k: v / np.linalg.norm(v) for k, v in vectors.items() if v.any()}


def _nearest(prototypes: dict[str, np.ndarray], dimensions: int):
    """A function of texts that gives the nearest of the prototypes and its cosine; for a text without a letter, none and -2."""
    names = list(prototypes)
    matrix = np.array([prototypes[x] for x in names]).reshape(len(names), dimensions)

    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = _Vectors(dimensions)
        for texts in parts:
            langs, scores = [], []
            for start, stop in cuts(texts, _BYTES, _TEXTS):
                codes, counts = counted(texts.slice(start, stop - start).to_pylist())
                total = vectors.bundles(codes, counts)
                cosine = total @ matrix.T / np.maximum(np.linalg.norm(total, axis=1), 1e-300)[:, None]
                best = cosine.argmax(axis=1) if names else np.zeros(len(counts), int)
                some = counts.any(axis=1) & bool(names)
                langs += [names[b] if yes else None for b, yes in zip(best, some)]
                scores += [float(c[b]) if yes else -2.0 for c, b, yes in zip(cosine, best, some)]
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(langs, pa.string())], ["score", "lang"])

    return found


def language(text: Column, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> Column:
    """A struct of lang_pred and score, the cosine (0 if negative).

    Texts that are null or have no letter (of any Unicode category L*) are ``und`` with score 0; ties go to the first
    name. Texts of any length are read whole. Prototypes go to the tasks in blocks of BLOCK languages."""
    names = sorted(prototypes)
    blocks = [{x: prototypes[x] for x in names[i : i + BLOCK]} for i in range(0, len(names), BLOCK)] or [{}]
    found = [F.arrow_udf(_nearest(b, dimensions), "score double, lang string")(text.cast("string")) for b in blocks]
    best = reduce(lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a), found)
    return F.struct(F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), best["score"])).alias("score"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """keep columns, lang_pred and score of each row; see ``language``."""
    told = spare_name(docs, "told")
    found = docs.select(*[F.col(f"`{c}`") for c in keep], language(F.col(f"`{text_col}`"), prototypes, dimensions).alias(told))
    return found.select(*[F.col(f"`{c}`") for c in keep], f"{told}.*")


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text is divisible by 5; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def recognised(docs: DataFrame, least: float = CHANCE) -> DataFrame:
    """The documents whose language is known: those that are ``und`` go, and those that are no nearer to any language than chance is (score below least).

    All columns stay, lang as it is; where no language can be learned, the documents with a letter stay. The rows
    themselves stay in the JVM, only texts go to Python."""
    prototypes, told = learn(training_rows(docs)), spare_name(docs, "told")
    if not prototypes:
        return docs.where(F.regexp_count(F.col("text").cast("string"), F.lit("\\p{L}")) > 0)
    known = docs.withColumn(told, language(F.col("text"), prototypes)).where((F.col(f"{told}.lang_pred") != UNKNOWN) & (F.col(f"{told}.score") >= least))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every row of documents, learned from the rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0; empty tables give an empty result; repeated rows
    and ids are rows of their own, a null id is neither held out nor learned from; ties go to the first language by
    name; other columns are not read."""
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, learn(training_rows(docs)), ["doc_id", "held_out"])
