"""Quality classifier by co-training two views of a document.

One view sees the text: its words, their shapes and measures of it. The other sees what is known about the document:
source, language and length. Each view is a naive Bayes model over hashed features. In every round a view learns from
the labelled rows and from the unlabelled rows of which the other view is sure; all rows take part, and tasks send back
counts of fixed size only. A fifth of the labelled rows is not learned from: on it each view's score is calibrated to a
probability, and its ranking is measured round by round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import documents, written
from .slices import sliced
from .sums import summed_arrays

#: Buckets of a view's features, of which the first are for measures; rounds, and how sure a view must be to teach the other.
BUCKETS, MEASURES, ROUNDS, SURE = 1 << 16, 1 << 12, 3, 0.95
#: Labelled rows that the views learn from, about, chosen by a hash of their ids.
MAX_LABELLED = 50_000
VIEWS = ("text", "page")
#: Documents that a feature is taken to be in besides those seen, in the classes' usual shares.
PRIOR_DOCUMENTS = 1.0
#: Bins of scores from which a view is calibrated; their inverse hyperbolic sines are spaced evenly and reach beyond any score.
_BINS, _REACH = 2000, 16.0


def _measure(said: bytes) -> int:
    return zlib.crc32(said) % MEASURES


def _bucket(word: bytes) -> int:
    return MEASURES + zlib.crc32(word) % (BUCKETS - MEASURES)


_SHAPES = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))
_RUNS = re.compile(rb"(.)\1+")


def _tenths(part: int, whole: int) -> int:
    return min(10, 10 * part // max(1, whole))


def text_features(text: str | None) -> list[int]:
    """The words, their shapes (letters, capitals, digits and signs, runs as one) and measures of the text in tenths."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, times = len(words), Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shapes = Counter()
    for w, k in times.items():
        shapes[_RUNS.sub(rb"\1", w.translate(_SHAPES))] += k
    ends = sum(k for x, k in shapes.items() if x[-1:] in b".!?")
    plain = sum(shapes[x] for x in (b"a", b"Aa", b"a,", b"a.", b"Aa.", b"Aa,"))
    shouted = sum(k for x, k in shapes.items() if b"A" in x and b"a" not in x)
    short = sum(k for w, k in times.items() if len(w) <= 3)
    measures = {
        "words": n.bit_length(), "distinct": _tenths(len(times), n), "pairs": _tenths(pairs, n), "most": _tenths(max(times.values(), default=0), n), "lines": _tenths(len(set(lines)), len(lines)),
        "ends": _tenths(ends, n), "plain": _tenths(plain, n), "shouted": _tenths(shouted, n), "short": _tenths(short, n), "length": min(20, len(raw) // max(1, n)), "kinds": len(shapes).bit_length(),
    }
    size = "few " if n < 20 else ""  # tenths of a few words are a matter of their own
    kinds = {_bucket(b"shape " + x) for x in shapes} | {_bucket(b"word " + w) for w in times}
    return sorted({_measure(f"{size}{k} {v}".encode()) for k, v in measures.items()} | kinds)


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    size = -1 if n_chars is None else int(max(0, n_chars)).bit_length()
    return sorted({_measure(x.encode("utf-8", "replace")) for x in (f"source {source}", f"lang {lang}", f"size {size}", f"{source} {size}")})


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = lambda rows: pa.array([np.array(x, "<u2").tobytes() for x in rows], pa.binary())
    for batch in sliced(batches, 1):
        text = pack(map(text_features, batch.column(1).to_pylist()))
        page = pack(page_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))))
        yield pa.RecordBatch.from_arrays([batch.column(0), text, page], ["doc_id", "text", "page"])


def features(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, packed features of both views, label (null if unknown) and whether the row calibrates. labels: doc_id, quality; of several for an id the least counts.

    Beyond max_labelled labelled ids a hash chooses about so many, and the others are rows without a label: so labels are
    broadcast, and the features, which are many times as large, are not shuffled to meet them."""
    slim = docs.select("doc_id", F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    made = slim.mapInArrow(_featured, slim.select("doc_id").schema.add("text", "binary").add("page", "binary"))
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = written(known, "labelled")
    if (n := known.count()) > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 32)) < int((1 << 32) * max_labelled / n))
    checks = F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id")), F.lit(5)) == 0
    return made.join(F.broadcast(known), "doc_id", "left").withColumn("checks", F.col("label").isNotNull() & checks)


class View:
    """Log-odds of the buckets, and the calibration that turns their sum into a probability.

    A bucket's log-odds are weighed by 1 - 2 / G, at least 0, where G is twice the log-likelihood ratio of its classes
    against the usual shares: what Akaike's criterion takes for chance says nothing."""

    def __init__(self, counts: np.ndarray):
        """counts: for either class the rows that have each bucket, and behind them the rows."""
        rows = counts[:, -1] + 1.0
        usual, seen = (rows / rows.sum())[:, None], counts[:, :-1]
        whole = seen.sum(axis=0)
        ratio = 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(whole * u, 1e-300)), 0.0) for x, u in zip(seen, usual))
        lift = np.log((seen / usual + PRIOR_DOCUMENTS) / (whole + PRIOR_DOCUMENTS))
        self.odds = np.maximum(0.0, 1 - 2 / np.maximum(ratio, 1e-9)) * (lift[1] - lift[0])
        self.slope, self.offset = 1.0, float(np.log(rows[1] / rows[0]))
        #: Rows of either class that it learned from; of the rows that calibrate it, how often a good one ranks above a bad one.
        self.taught, self.auc = counts[:, -1].astype(np.int64).tolist(), None

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What the measures say, and what words and shapes say over the root of the number of them that say something: there are many, and they say much the same."""
        said, words = self.odds[flat], flat >= MEASURES
        parts = np.array([np.where(words, 0.0, said), np.where(words, said, 0.0), words & (said != 0)], float)
        sums, full = np.zeros((3, len(lengths))), lengths > 0
        if len(flat):
            sums[:, full] = np.add.reduceat(parts, np.r_[0, np.cumsum(lengths)[:-1]][full], axis=1)
        return sums[0] + sums[1] / np.sqrt(np.maximum(1.0, sums[2]))

    def chance(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))

    def calibrate(self, scores: np.ndarray, counts: np.ndarray) -> None:
        """Logistic regression on one score by Newton's steps, halved where they don't help. counts: rows of either class at each score; a ridge keeps it finite."""
        n, good = counts.sum(axis=0), counts[1]
        if not n.sum():
            return
        if counts.sum(axis=1).all():
            below = np.cumsum(counts[0]) - counts[0] / 2
            self.auc = float((good * below).sum() / (good.sum() * counts[0].sum()))
        unit = float(np.sqrt((n * scores * scores).sum() / n.sum())) or 1.0
        x = np.array([scores / unit, np.ones(len(scores))])
        loss = lambda at: float((n * np.logaddexp(0, at @ x) - good * (at @ x)).sum() + 5e-3 * at @ at)
        at = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
            slope = x @ (n * p - good) + 1e-2 * at
            move = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + 1e-2 * np.eye(2), slope)
            while loss(at - move) > loss(at) and np.abs(move).max() > 1e-12:
                move = move / 2
            at = at - move
            if np.abs(move).max() < 1e-10:
                break
        self.slope, self.offset = float(max(0.0, at[0]) / unit), float(at[1])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").astype(np.int64), np.array([len(x) // 2 for x in rows], np.int64)


def _labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """-1 where unknown; and which rows calibrate."""
    return np.array([-1 if x is None else x for x in batch.column("label").to_pylist()], np.int64), np.array(batch.column("checks").to_pylist(), bool)


def _totals(table: DataFrame, task, width: int) -> np.ndarray:
    """Sums over all tasks of the fixed-size counts that task yields, by view and class."""
    parts = table.mapInArrow(task, "view int, class int, counts array<double>")
    out = np.zeros((2, 2, width))
    for key, counts in summed_arrays(parts, ["view", "class"], "counts").items():
        out[key] = counts
    return out


def _sent(counts: np.ndarray) -> pa.RecordBatch:
    where = [(v, c) for v in range(2) for c in range(2)]
    return pa.RecordBatch.from_arrays([pa.array([v for v, _ in where], pa.int32()), pa.array([c for _, c in where], pa.int32()), pa.array([counts[x].tolist() for x in where], pa.list_(pa.float64()))], ["view", "class", "counts"])


def _count(views: list[View] | None, sure: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, BUCKETS + 1))
        for batch in batches:
            label, checks = _labels(batch)
            packed = [_unpacked(batch.column(v)) for v in VIEWS]
            for v in range(2):
                y = np.where(checks, -1, label)
                if views:  # the other view teaches what it is sure of
                    p = views[1 - v].chance(views[1 - v].score(*packed[1 - v]))
                    y = np.where((label < 0) & (p >= sure), 1, np.where((label < 0) & (p <= 1 - sure), 0, y))
                flat, lengths = packed[v]
                each = np.repeat(y, lengths)
                for c in range(2):
                    counts[v, c, :-1] += np.bincount(flat[each == c], minlength=BUCKETS)
                    counts[v, c, -1] += (y == c).sum()
        yield _sent(counts)

    return task


def _bins(scores: np.ndarray) -> np.ndarray:
    return ((np.arcsinh(scores) + _REACH) / (2 * _REACH) * _BINS).astype(np.int64)


def _middles() -> np.ndarray:
    return np.sinh((np.arange(_BINS) + 0.5) / _BINS * 2 * _REACH - _REACH)


def _check(views: list[View]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, _BINS))
        for batch in batches:
            label, checks = _labels(batch)
            for v in range(2):
                place = _bins(views[v].score(*_unpacked(batch.column(VIEWS[v]))))
                for c in range(2):
                    counts[v, c] += np.bincount(place[checks & (label == c)], minlength=_BINS)
        yield _sent(counts)

    return task


def co_train(table: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> list[list[View]]:
    """The views of each round, the last ones last. Without labels both say one half of everything."""
    middles, views, history = _middles(), None, []
    for _ in range(rounds):
        counts = _totals(table, _count(views, sure), BUCKETS + 1)
        views = [View(counts[v]) for v in range(2)]
        checks = _totals(table.where("checks"), _check(views), _BINS)
        for v in range(2):
            views[v].calibrate(middles, checks[v])
        history.append(views)
    return history


def _score(views: list[View], prior: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [np.clip(view.chance(view.score(*_unpacked(batch.column(v)))), 1e-6, 1 - 1e-6) for v, view in zip(VIEWS, views)]
            logit = np.log(p[0] / (1 - p[0])) + np.log(p[1] / (1 - p[1])) - prior
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in (*p, 1 / (1 + np.exp(-logit)))]], ["doc_id", "p_text", "p_page", "score"])

    return task


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """doc_id, p_text, p_page, score and kept (score of one half or more) of each row: both chances of good quality and what they say together, the prior counted once.

    Null and empty texts have measures but no words; null source, language or length are features like any other. Texts
    are read whole. Repeated rows and ids are rows of their own, and of several labels of an id the least counts; a null
    id has none. Other columns are not read; without labels every score is one half; an empty table gives an empty one."""
    table = written(features(docs, labels), "features")
    views = co_train(table, rounds, sure)[-1]
    n = table.where("label is not null").groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")).first()
    prior = float(np.log((n["good"] + 1) / (n["n"] - n["good"] + 1)))
    schema = table.select("doc_id").schema.add("p_text", "double").add("p_page", "double").add("score", "double")
    return table.mapInArrow(_score(views, prior), schema).withColumn("kept", F.col("score") >= 0.5)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of good quality of every row of documents; see ``quality_scores`` for nulls, empty and long texts, repeats and other columns."""
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
