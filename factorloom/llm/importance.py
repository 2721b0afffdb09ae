"""Importance resampling towards a target's distribution of hashed n-grams.

An untrained pre-tokeniser (a Regex split over text whose A-Z are lowered) gives words with their offsets. A window is a
pair of offsets, from the start of one word to the end of the same or a later one; its CRC picks a bucket. Texts are
tokenised once: their buckets are a table, from which the histogram of all documents is counted and, once the gains of
the buckets are known, the weights are summed. Documents are drawn without replacement by adding Gumbel noise that is a
hash of the id, so the draw is the same whenever and wherever it is made.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .scratch import documents, numbered_rows, spare_name, written
from .slices import sliced

#: Words in the longest window, buckets, words that a document needs to be drawn, documents drawn of a hundred, and the seed.
WIDTH, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: What parts words once A-Z are lowered: everything in ASCII but digits and letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that are tokenised at a time; words are never cut.
STRETCH = 1 << 16


class Splitter:
    """Words of a text with offsets."""

    def __init__(self) -> None:
        self.split = Split(Regex(APART), "removed")

    def words(self, text: str | None) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """For each stretch of the lowered text its words and their offsets in the stretch; a word is in one stretch."""
        lowered = (text or "").encode("utf-8", "replace").lower().decode()  # bytes lower A-Z only
        start = 0
        while start < len(lowered):
            stop = start + STRETCH
            while stop < len(lowered) and (lowered[stop].isalnum() or lowered[stop] >= "\x80"):
                stop += 1
            yield self.split.pre_tokenize_str(lowered[start:stop])
            start = stop

    def buckets(self, text: str | None, width: int = WIDTH, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
        """(number of words, buckets of all windows of up to width words).

        Words are laid out with one space between them. A window that is a word longer ends at the next offset, so its
        CRC goes on from that of the window without the last word."""
        n, found = 0, []
        last: list[list[int]] = []  # CRCs of the windows of 1, 2, ... words that end at the last words so far
        for words in self.words(text):
            plain = [w.encode() for w, _ in words]
            spaced = [b" " + w for w in plain]
            n += len(plain)
            shorter = list(map(crc32, plain))
            found += shorter
            held = [shorter]
            for k in range(1, width):
                carried = last[k - 1] if last else []  # the window of k words that ends where the last stretch did, if there is one
                later = spaced if carried else spaced[len(spaced) + 1 - len(shorter) :]
                shorter = list(map(crc32, later, carried + shorter))
                found += shorter
                held.append(shorter)
            if plain:
                last = [x[-1:] for x in held]
        return n, (np.array(found, np.uint32) % np.uint32(n_buckets)).astype(np.int16 if n_buckets <= 1 << 15 else np.int32)


def _hashed(width: int, n_buckets: int):
    """For mapInArrow over (id, text, anything): id, n_words and the buckets of the windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        collects = gc.isenabled()
        gc.disable()  # words come as many small tuples without cycles, over which collections would run again and again
        try:
            for batch in sliced(batches, 1, 1 << 19):
                each = [splitter.buckets(x, width, n_buckets) for x in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) for _, x in each)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in each]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([n for n, _ in each], pa.int64()), lists], [*(x for i, x in enumerate(batch.schema.names) if i != 1), "n_words", "buckets"])
        finally:
            if collects:
                gc.enable()

    return task


def hashed(rows: DataFrame, text_col: str = "text", width: int = WIDTH, n_buckets: int = BUCKETS) -> DataFrame:
    """rows without the text, with n_words and buckets (one for each window of 1 to width words)."""
    first, *rest = [c for c in rows.columns if c != text_col]
    slim = rows.select(F.col(f"`{first}`"), F.col(f"`{text_col}`").cast("string").alias(text_col), *[F.col(f"`{c}`") for c in rest])
    return slim.mapInArrow(_hashed(width, n_buckets), slim.drop(text_col).schema.add("n_words", "long").add("buckets", T.ArrayType(T.IntegerType())))


def histogram(found: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs. Tasks count their own rows; a row for each bucket reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in found.select("buckets").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more frequent a bucket is in the target, with one added to each count; floors."""
    n = len(raw)
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _summed(gain: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths), pa.array(upto[ends] - upto[ends - lengths])], [*batch.schema.names[:-1], "n_features", "weight"])

    return task


def noise(id_col: str, seed: int = SEED):
    """Thousandths of Gumbel noise that a hash of the seed and the id gives; a null id hashes as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible, percent: float, id_col: str, tie: list[str]) -> DataFrame:
    """rows with ``rank``: 1, 2, ... by falling score, then id, of the eligible ones, as far as floor(percent * n / 100).

    Eligible rows are sorted by ranges of the score, so no task has them all; a row for each range tells where its ranks begin."""
    order = [F.desc("score"), F.col(f"`{id_col}`").asc_nulls_last(), *[F.col(c) for c in tie]]
    able = rows.where(eligible)
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(able.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, begin = 0, []
    for part in sorted(counts):
        begin.append((part, before))
        before += counts[part]
    starts = rows.sparkSession.createDataFrame(begin, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rank = F.col("_before") + place
    drawn = placed.join(F.broadcast(starts), "_range").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= int(percent * before // 100), F.col("rank")))
    return drawn.drop("_range", "_before").unionByName(rows.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least_words: int = LEAST_WORDS, percent: float = PERCENT, seed: int = SEED, width: int = WIDTH, n_buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank and the columns of keep) of every row of docs; rank is null if the row is not drawn.

    target: texts whose distribution is to be met. Null and empty texts have no words, no features and weight 0. Very
    long texts are tokenised in stretches; their windows go on across them. Repeated rows are rows of their own and
    share their score; ties go to the smaller id. Ids may be of any type that casts to a string; null ids share one
    noise and come last among equals. Other columns are not read, an empty table gives an empty one, and an empty
    target leaves the frequent buckets with the least gains."""
    keep = keep or []
    slim = docs.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("\ttext"))
    found = written(hashed(slim, "\ttext", width, n_buckets), "buckets")
    wanted = hashed(target.select(F.lit(0).alias("no"), F.col(f"`{target_col}`").alias("text")), "text", width, n_buckets)
    gain = gains(histogram(found, n_buckets), histogram(wanted, n_buckets))
    names = [id_col, *keep]
    sums = found.select(*[F.col(f"`{c}`") for c in names], "n_words", "buckets")
    sums = sums.mapInArrow(_summed(gain), sums.drop("buckets").schema.add("n_features", "long").add("weight", "long"))
    scored = written(sums.withColumn("score", F.col("weight") + noise(id_col, seed)), "scores")
    return ranked(scored, F.col("n_words") >= least_words, percent, id_col, [f"`{c}`" for c in keep])


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; docs is read from files. See ``weighed``."""
    rid = spare_name(docs, "rid")
    numbered = numbered_rows(docs, rid)
    drawn = weighed(numbered, target, id_col, text_col, keep=[rid], **options).where("rank is not null").select(rid)
    return numbered.join(drawn, rid, "left_semi").drop(rid)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its weight towards the benchmark's texts and its rank if it is drawn; see ``weighed`` for nulls, empty and long texts, ties, repeats and other columns."""
    found = weighed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"), "n_words")


def _features(table: str, key: str) -> str:
    """SQL: (key, feature) for each window of the table's texts."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = lambda k: " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    parts = " UNION ALL ".join(f"SELECT {key}, {run(k)} AS f FROM (SELECT {key}, w, unnest(range(1, len(w) + {2 - k})) AS i FROM x)" for k in range(1, WIDTH + 1))
    return f"(WITH x AS (SELECT {key}, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}) {parts})"


#: CRC32 in SQL: the table of a byte's remainders, then a fold over the bytes.
OP11_SQL = f"""
WITH byte_table AS (SELECT list(r ORDER BY b) AS r FROM (
    SELECT b, list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS r FROM range(256) t(b))),
feature AS (SELECT 0 AS side, * FROM {_features("documents", "doc_id")} UNION ALL SELECT 1, * FROM {_features("benchmark", "item_id")}),
bytes AS (SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT) AS bs FROM (SELECT DISTINCT f FROM feature)),
bucket AS (SELECT f, xor(list_reduce(list_concat([4294967295::UBIGINT], bs), lambda c, x: xor(c >> 8, r[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT % {BUCKETS} AS k FROM bytes, byte_table),
counted AS (SELECT k, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM feature JOIN bucket USING (f) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM counted) + {BUCKETS})::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM counted) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM counted),
weight AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM (SELECT doc_id, f FROM feature WHERE side = 0) JOIN bucket USING (f) JOIN gain USING (k) GROUP BY doc_id),
words AS (SELECT doc_id, len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))::BIGINT AS n_words FROM documents),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, n_words,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weight USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank, n_words FROM scored LEFT JOIN placed USING (doc_id)
"""
