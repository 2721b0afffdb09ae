"""SimHash near-dedup by tiled exact comparison.

Fingerprints link if they differ in at most ``radius`` bits. Nodes (distinct fingerprints) are dealt by keys, of which
two that link share one. Among the rows of a key, in order of their population counts, tiles are compared with numpy's
exclusive-or and bit counts; tile pairs whose population counts differ by more than the radius are skipped.
A run of rows too long for a task leaves it in blocks, and the pairs of its blocks are dealt out as tasks of their own.

Two kinds of keys: 64 bits in six blocks, of which any two within 3 bits share three, so the keys of every three blocks
lose no link; and, for similarities too low for that, bands of minima of the shingles' hashes with a fingerprint of 256 bits.

With bands the fingerprints only choose what the texts confirm. First the nearest links that would join all candidates of
a key are confirmed, which makes one of a group of copies however large. Then the rows of a key that still have candidates
in other components are dealt once more with their shingles' hashes, and all these candidates are confirmed or refused
where they meet: a task returns the links that join something, and no pair that is refused is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import documents, spare_name, written
from .slices import sliced

SEED, BITS, WIDTH, RADIUS, BLOCKS, TILE = 42, 64, 3, 3, 6, 64
#: Rows of a key that are compared in one task; longer runs are dealt out by pairs of blocks of so many rows.
LONGEST = 1 << 14
#: Near copies on shingles of five words: words of a fingerprint, bits that may differ, bands and minima in a band.
#: Distinct shingles with a Jaccard similarity of 0.8 or more have a cosine of 8/9 or more: 39 of 256 bits on average with a
#: deviation of 6, and 48 if there are few shingles. Links within the first radius go first; none beyond the second is looked
#: at, which is 5.8 deviations off (3.9 for few shingles, where it loses about as little as the bands do).
NEAR_WIDTH, NEAR_WORDS, NEAR_RADIUS, FAR_RADIUS, BANDS, MINIMA, SIMILAR = 5, 4, 48, 72, 20, 4, 0.8
#: Candidates of a row that a task compares in its first round; each round has so many times more.
NEAREST = 16
#: Hashes of shingles that a block of rows may hold where candidates are compared.
HASHES = 1 << 21
#: Words of 64 bits, for each id, of the marks that choose texts before they are shuffled, and words at most.
MARKS, MOST_MARKS = 0.25, 1 << 20


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the shingles, repeats included; of the whole sequence if there are fewer words. A-Z are lowered and ASCII white space splits, as bytes do it."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Each of 64 bits is set if it is in over half of h; 0 without any."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    return majority(shingle_hashes(text, width))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def wide_fingerprint(text: bytes | None, width: int = NEAR_WIDTH) -> list[int]:
    """NEAR_WORDS words of 64 bits, from as many hashes of each distinct shingle."""
    return _wide(np.unique(shingle_hashes(text, width)))


def _wide(h: np.ndarray) -> list[int]:
    return [majority(h if not k else _mixed(h + np.uint64(k << 56))) for k in range(NEAR_WORDS)]


def _bands(h: np.ndarray) -> np.ndarray:
    """A key for each band: its minima over the shingles, each of hashes times a factor of its own. Without shingles all are 0."""
    if not len(h):
        return np.zeros(BANDS, np.int64)
    least = np.array([(h * a).min() for a in _FACTORS]).reshape(BANDS, MINIMA)
    key = least[:, 0]
    for k in range(1, MINIMA):
        key = _mixed(key) ^ least[:, k]
    return _mixed(key).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        found = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        words, keys, n = np.empty((NEAR_WORDS, batch.num_rows), np.uint64), [], np.empty(batch.num_rows, np.int64)
        for i, text in enumerate(batch.column(1).to_pylist()):
            h = np.unique(shingle_hashes(text, NEAR_WIDTH))
            words[:, i], n[i] = _wide(h), len(h)
            keys.append(_bands(h))
        ends = pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32))
        bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in words], bands, pa.array(n)], ["id", *_words(NEAR_WORDS), "bands", "n"])


def _words(n: int) -> list[str]:
    return [f"f{k}" for k in range(n)]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    return _slim(docs, id_col, text_col).mapInArrow(_fingerprints, "id long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """As signed numbers, the bits of every choice of blocks - radius blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(x)).astype(np.int64)) for x in combinations(parts, blocks - radius)]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins, in label (of each row the first row of its component), what the links (i, j) join. Returns the places of links that are enough for that."""
    live, kept = np.arange(len(i)), [np.empty(0, np.int64)]
    while len(live):
        a, b = label[i[live]], label[j[live]]
        apart = a != b
        live, high, low = live[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        roots, pick = np.unique(high, return_index=True)
        kept.append(live[pick])
        label[roots] = low[pick]
        while (label[label] != label).any():
            label[:] = label[label]
    return np.concatenate(kept)


def _forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links (i, j) among n rows, those of least distance that join what all of them join: fewer than n."""
    label, kept = np.arange(n), [np.empty(0, np.int64)]
    for level in np.unique(far):
        live = np.flatnonzero(far == level)
        kept.append(live[_join(label, i[live], j[live])])
    kept = np.concatenate(kept)
    return i[kept], j[kept], far[kept]


def tiled_links(run: np.ndarray, pop: np.ndarray, words: np.ndarray, radius: int, tile: int = TILE, side: np.ndarray | None = None, compared: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, bits that differ) that join what rows of the same run at most radius bits apart join, the nearest first.

    words: a row for each 64 bits. Rows are in order of (run, pop). side: only rows of different sides are compared.
    compared gets the pairs of tiles that were not skipped."""
    n = len(run)
    m = -(-n // tile)
    fill = lambda x, v: np.concatenate([x, np.full(m * tile - n, v, x.dtype)]).reshape(m, tile)
    runs, sides, bits = fill(run, -1), None if side is None else fill(side, False), [fill(x, 0) for x in words]
    first = np.arange(m) * tile
    last = np.minimum(first + tile, n) - 1
    upper = np.triu(np.ones((tile, tile), bool), 1)
    found, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16))], 0
    joined = lambda: _forest(n, *(np.concatenate(x) for x in zip(*found)))
    s, lag = np.arange(m), 0
    while len(s):
        if compared is not None:
            compared += zip(s.tolist(), (s + lag).tolist())
        for k in range(0, len(s), 64):
            x, y = s[k : k + 64], s[k : k + 64] + lag
            far = np.zeros((len(x), tile, tile), np.uint16)
            for b in bits:
                far += np.bitwise_count(b[x][:, :, None] ^ b[y][:, None, :])
            near = (far <= radius) & (runs[x][:, :, None] == runs[y][:, None, :])
            if sides is not None:
                near &= sides[x][:, :, None] != sides[y][:, None, :]
            if not lag:
                near &= upper
            p, i, j = np.nonzero(near)
            bits_off = far[p, i, j]
            i, j = x[p] * tile + i, y[p] * tile + j
            live = (i < n) & (j < n)
            found.append((i[live], j[live], bits_off[live]))
            held += len(found[-1][0])
            if held > max(4 * n, 1 << 18):
                found = [joined()]
                held = len(found[0][0])
        lag += 1
        s = s[s + lag < m]
        # later tiles lie in a later run or, in the same one, farther off
        s = s[(run[last[s]] == run[first[s + lag]]) & (pop[first[s + lag]] - pop[last[s]] <= radius)]
    return joined()


def _schema(words: int) -> str:
    return "a long, b long, c int, m long, block int, pop int, " + ", ".join(f"{w} long" for w in _words(words))


def _made(words: int, a, b=None, more: list | None = None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * words]
    other = [pa.nulls(len(a), k) for k in kinds] if more is None else [pa.array(x, k) for x, k in zip(more, kinds)]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), *other], [x.split()[0] for x in _schema(words).split(", ")])


def _compare(words: int, radius: int, tile: int, longest: int):
    """For mapInArrow over rows in order of (c, m, pop): links of the runs of equal (c, m), and the rows of runs that are too long, with block numbers."""
    names = ["c", "m", "pop", "node", *_words(words)]

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of whole runs."""
        c, m, pop, node, *fp = rows
        run = np.cumsum(np.r_[False, (c[1:] != c[:-1]) | (m[1:] != m[:-1])])
        i, j, _ = tiled_links(run, pop, np.array(fp).view(np.uint64), radius, tile)
        if len(i):
            yield _made(words, node[i], node[j])

    def leaving(rows: list[np.ndarray], sent: int) -> pa.RecordBatch:
        return _made(words, rows[3], None, [rows[0], rows[1], (sent + np.arange(len(rows[0]))) // longest, *rows[2:3], *rows[4:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        long_run, sent = None, 0  # the key of a run that leaves in blocks, and its rows so far
        for batch in batches:
            new = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
            if long_run:
                k = int(((new[0] == long_run[0]) & (new[1] == long_run[1])).sum())  # they come first
                if k:
                    yield leaving([x[:k] for x in new], sent)
                    sent, new = sent + k, [x[k:] for x in new]
                if not len(new[0]):
                    continue
                long_run = None
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            last = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])
            if last:
                yield from links([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) > longest:
                long_run, sent = (int(held[0][0]), int(held[1][0])), len(held[0])
                yield leaving(held, 0)
                held = None
        if held is not None and len(held[0]):
            yield from links(held)

    return task


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of names, by which they are sorted."""
    held: pa.RecordBatch | None = None

    def bounds(rows: pa.RecordBatch) -> np.ndarray:
        key = np.stack([rows.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names])
        return np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])

    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        edges = bounds(held)
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield held.slice(a, b - a)
        held = held.slice(edges[-2])
    if held is not None and held.num_rows:
        yield held


def _compare_pairs(words: int, radius: int, tile: int):
    """For mapInArrow over rows in order of (c, m, t1, t2): links of each pair of blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ["c", "m", "t1", "t2"]):
            order = np.argsort(part.column("pop").to_numpy(zero_copy_only=False), kind="stable")
            pop, first, node, *fp = (part.column(x).to_numpy(zero_copy_only=False)[order] for x in ("pop", "first", "a", *_words(words)))
            same = part.column("t1")[0].as_py() == part.column("t2")[0].as_py()
            i, j, _ = tiled_links(np.zeros(len(pop), np.int64), pop, np.array(fp).view(np.uint64), radius, tile, None if same else first)
            if len(i):
                yield _made(words, node[i], node[j])

    return task


def dealt_links(dealt: DataFrame, words: int, radius: int, tile: int = TILE, longest: int = LONGEST) -> DataFrame:
    """dealt: c, m (the key), pop, node and words. Links (a, b) of nodes that share a key and lie within the radius: enough to join all that such links join."""
    dealt = dealt.repartition("c", "m").sortWithinPartitions("c", "m", "pop", "node")
    found = written(dealt.mapInArrow(_compare(words, radius, tile, longest), _schema(words)), "links")
    links, rows = found.where("b is not null").select("a", "b"), found.where("b is null").drop("b")
    if rows.isEmpty():
        return links
    blocks = rows.groupBy("c", "m", "block").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.m") == F.col("y.m")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.low") - F.col("x.high") <= radius))
    pairs = written(pairs.select("x.c", "x.m", F.col("x.block").alias("t1"), F.col("y.block").alias("t2")), "block_pairs")
    ends = pairs.select("c", "m", "t1", "t2", F.col("t1").alias("block"), F.lit(True).alias("first"))
    ends = ends.union(pairs.where("t1 < t2").select("c", "m", "t1", "t2", F.col("t2").alias("block"), F.lit(False).alias("first")))
    each = rows.join(ends, ["c", "m", "block"]).select("c", "m", "t1", "t2", "first", "pop", "a", *_words(words))
    each = each.repartition("c", "m", "t1", "t2").sortWithinPartitions("c", "m", "t1", "t2")
    return links.union(each.mapInArrow(_compare_pairs(words, radius, tile), _schema(words)).select("a", "b"))


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, **options) -> DataFrame:
    """fps: distinct bigint fp. Links between fp at most radius bits apart."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("m")) for i, mask in enumerate(_masks(radius, blocks))]))
    dealt = fps.select("fp", F.bit_count("fp").alias("pop"), keys.alias("k")).select("k.c", "k.m", "pop", F.col("fp").alias("node"), F.col("fp").alias("f0"))
    return dealt_links(dealt, 1, radius, **options)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **options) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id whose text the row's text reaches by links.

    Null and empty texts have fingerprint 0, which links as any other. Long texts are read whole. Ids are whole
    numbers; null ids are never a component_id unless a component has no other. Repeated rows are rows of their own,
    other columns are not read, and an empty table gives an empty one."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = components(near_links(distinct.select("fp"), radius, **options)).select(F.col("node").alias("fp"), "label")
    named = written(distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return each.join(named.join(least, "label").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes, each sorted; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _similar(width: int, least: float):
    """For mapInArrow over (a, b, text of a, text of b): the links whose texts are similar."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            sets = ([np.unique(shingle_hashes(x, width)) for x in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([similarity(x, y) >= least for x, y in zip(*sets)], pa.bool_()))

    return task


def marked(rows: DataFrame, ids: DataFrame, most: int = MOST_MARKS) -> DataFrame:
    """Of rows, which have an id, those whose id is in ids and a few others (one in about a hundred; more if most words are too few for ids).

    ids leave three bits each, in one word of a table that is broadcast: some bytes for four ids, so that rows
    are chosen where they are read."""
    words = max(1, min(most, int(MARKS * ids.count())))
    h = F.xxhash64("id")
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(63).cast("int")) for k in (0, 6, 12)]
    word, pattern = F.pmod(F.shiftright(h, 18), F.lit(words)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])
    marks = written(ids.select(word.alias("word"), pattern.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "marks")
    return rows.join(F.broadcast(marks), (word == F.col("word")) & (F.col("bits").bitwiseAND(pattern) == pattern), "left_semi")


def texts_of(slim: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the distinct ids; slim: id and text. Of an id with several texts the least counts. Texts of other ids are not shuffled but for the few that ``marked`` lets through."""
    return marked(slim, ids).join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def similar_links(links: DataFrame, slim: DataFrame, width: int = NEAR_WIDTH, least: float = SIMILAR) -> DataFrame:
    """The links (a, b) whose texts have a Jaccard similarity of least or more. slim: id and text; of an id with several texts the least text counts."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    needed = written(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct(), "needed")
    texts = written(texts_of(slim, needed), "texts")
    pairs = links.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(_similar(width, least), "a long, b long")


def apart_pairs(label: np.ndarray, pop: np.ndarray, n: np.ndarray, words: np.ndarray, radius: int, least: float, tile: int, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits that differ) of rows with different labels, and different sides if given, within the radius, whose sets of n elements may have a similarity of least.

    Pairs of tiles are skipped if their population counts or sizes are too far apart or all their rows have one label."""
    order = np.lexsort((pop, label)) if len(np.unique(label)) < len(label) else np.argsort(pop, kind="stable")
    m = -(-len(order) // tile)
    padded = np.concatenate([order, np.full(m * tile - len(order), order[-1])]).reshape(m, tile)
    real = (np.arange(m * tile) < len(order)).reshape(m, tile)
    bits, labels, sizes = [w[padded] for w in words], label[padded], n[padded]
    sides = None if side is None else side[padded]
    low, high = ({k: f(x[padded], axis=1) for k, x in (("label", label), ("pop", pop), ("n", n))} for f in (np.min, np.max))
    upper = np.triu(np.ones((tile, tile), bool), 1)
    for lag in range(m):
        s = np.arange(m - lag)
        t = s + lag
        one = (low["label"][s] == high["label"][t]) & (high["label"][s] == low["label"][t])
        far_off = (low["pop"][t] - high["pop"][s] > radius) | (low["pop"][s] - high["pop"][t] > radius)
        sized = (high["n"][s] >= least * low["n"][t]) & (high["n"][t] >= least * low["n"][s])
        s = s[~one & ~far_off & sized]
        for k in range(0, len(s), 64):
            x, y = s[k : k + 64], s[k : k + 64] + lag
            far = np.zeros((len(x), tile, tile), np.uint16)
            for b in bits:
                far += np.bitwise_count(b[x][:, :, None] ^ b[y][:, None, :])
            near = (far <= radius) & (labels[x][:, :, None] != labels[y][:, None, :]) & real[x][:, :, None] & real[y][:, None, :]
            near &= (sizes[x][:, :, None] >= least * sizes[y][:, None, :]) & (sizes[y][:, None, :] >= least * sizes[x][:, :, None])
            if sides is not None:
                near &= sides[x][:, :, None] != sides[y][:, None, :]
            if not lag:
                near &= upper
            p, i, j = np.nonzero(near)
            yield padded[x[p], i], padded[y[p], j], far[p, i, j]


def _nearest(k: int, owner: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which entries are among the k nearest of their owner."""
    order = np.lexsort((far, owner))
    new = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
    near = np.empty(len(owner), bool)
    near[order] = np.arange(len(owner)) - np.repeat(new, np.diff(np.r_[new, len(owner)])) < k
    return near


def _similarities(i: np.ndarray, j: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the sets of rows i and j. items[starts[r]:ends[r]] are the members of r's set, numbers below len(marks); marks are False."""
    found, order = np.empty(len(i)), np.argsort(i, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0, True])
    for a, b in zip(edges[:-1], edges[1:]):
        for at in np.split(order[a:b], range(1024, b - a, 1024)):
            row, others = i[at[0]], j[at]
            own, sizes = items[starts[row] : ends[row]], ends[others] - starts[others]
            stops = np.cumsum(sizes)
            marks[own] = True
            hits = np.r_[0, np.cumsum(marks[items[np.repeat(starts[others] - stops + sizes, sizes) + np.arange(stops[-1])]])]
            marks[own] = False
            both = hits[stops] - hits[stops - sizes]
            either = len(own) + sizes - both
            found[at] = np.where(either > 0, both / np.maximum(either, 1), 1.0)
    return found


def joining_links(label: np.ndarray, weight: np.ndarray, pop: np.ndarray, n: np.ndarray, words: np.ndarray, sets: list[np.ndarray], radius: int, least: float, tile: int, side: np.ndarray | None, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) that join what all ``apart_pairs`` join of which the sets have a similarity of least or more.

    Every such pair is compared, unless its ends are joined by then. The nearest of the rows of smaller components
    go first, and bounded numbers of pairs are held at a time."""
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - [len(x) for x in sets]
    values, items = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(len(values), bool)
    _, firsts, place = np.unique(label, return_index=True, return_inverse=True)
    own = firsts[place]
    kept, held = [(np.empty(0, np.int64), np.empty(0, np.int64))], []

    def compare() -> None:
        i, j, far = (np.concatenate(x) for x in zip(*held))
        held.clear()
        k = nearest
        while (live := own[i] != own[j]).any():
            i, j, far = i[live], j[live], far[live]
            now = _nearest(k, i, far)
            a, b = i[now], j[now]
            good = _similarities(a, b, starts, ends, items, marks) >= least
            a, b = a[good], b[good]
            link = _join(own, a, b)
            kept.append((a[link], b[link]))
            i, j, far = i[~now], j[~now], far[~now]
            k *= max(2, nearest)

    for i, j, far in apart_pairs(label, pop, n, words, radius, least, tile, side):
        swap = (weight[j] < weight[i]) | ((weight[j] == weight[i]) & (label[j] < label[i]))
        held.append((np.where(swap, j, i), np.where(swap, i, j), far))
        if sum(len(x[0]) for x in held) > 1 << 18:
            compare()
    if held:
        compare()
    i, j = (np.concatenate(x) for x in zip(*kept))
    return i, j


def _over_blocks(of, words: int):
    """For mapInArrow over rows in order of (c, m, t1, t2): of(rows, apart_pairs' columns label, pop, n and words, which of the rows are of the first block) for each pair of blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["c", "m", "t1", "t2"]):
            label, pop, n, first, *fp = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("label", "pop", "n", "first", *_words(words)))
            same = rows.column("t1")[0].as_py() == rows.column("t2")[0].as_py()
            found = of(rows, (label, pop, n, np.array(fp).view(np.uint64)), None if same else first)
            if found is not None and found.num_rows:
                yield found

    return task


def _link_rows(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(x)) for x in (i, j)], ["a", "b"])


def _nearest_links(radius: int, least: float, tile: int):
    """For ``_over_blocks``: candidates of least distance that join what all candidates join."""

    def of(rows: pa.RecordBatch, columns: tuple, side: np.ndarray | None) -> pa.RecordBatch:
        found, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16))], 0
        fewer = lambda: _forest(rows.num_rows, *(np.concatenate(x) for x in zip(*found)))
        for pairs in apart_pairs(*columns, radius, least, tile, side):
            found.append(pairs)
            held += len(pairs[0])
            if held > max(4 * rows.num_rows, 1 << 18):
                found = [fewer()]
                held = len(found[0][0])
        return _link_rows(rows, *fewer()[:2])

    return of


def _rows_apart(radius: int, least: float, tile: int):
    """For ``_over_blocks``: the rows that have candidates with other labels."""

    def of(rows: pa.RecordBatch, columns: tuple, side: np.ndarray | None) -> pa.RecordBatch:
        live = np.zeros(rows.num_rows, bool)
        for i, j, _ in apart_pairs(*columns, radius, least, tile, side):
            live[i] = live[j] = True
        return rows.drop_columns(["t1", "t2", "first"]).filter(pa.array(live))

    return of


def _joining(radius: int, least: float, tile: int, nearest: int):
    """For ``_over_blocks``: ``joining_links`` of rows with their sets."""

    def of(rows: pa.RecordBatch, columns: tuple, side: np.ndarray | None) -> pa.RecordBatch:
        label, *others = columns
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        return _link_rows(rows, *joining_links(label, rows.column("weight").to_numpy(), *others, sets, radius, least, tile, side, nearest))

    return of


def _dealt(rows: DataFrame, longest: int, hashes: int | None = None) -> DataFrame:
    """rows: c and m (the key), node, label and n. Those of keys with several labels, dealt out by key.

    A key with over longest rows, or over so many hashes, is salted first: its rows go to blocks by a hash, and each
    pair of blocks (t1, t2) is a task of its own."""
    size = F.count("*") / F.lit(longest)
    size = size if hashes is None else F.greatest(size, F.sum("n") / F.lit(hashes))
    mixed = rows.groupBy("c", "m").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(size).cast("int").alias("blocks")).where("x < y").select("c", "m", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.join(mixed, ["c", "m"]).withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("c", "m", F.least("own", "to").alias("t1"), F.greatest("own", "to").alias("t2"), (F.col("own") <= F.col("to")).alias("first"), *[x for x in rows.columns if x not in ("c", "m")])


def _by_blocks(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("c", "m", "t1", "t2").sortWithinPartitions("c", "m", "t1", "t2")


def _hash_sets(width: int):
    """For mapInArrow over (id, text): the distinct hashes of the text's shingles, as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = [np.unique(shingle_hashes(x, width)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return task


def _labelled(links: DataFrame) -> DataFrame:
    """(node, label, weight) of the components of links."""
    labels = written(components(links), "labels")
    return written(labels.join(labels.groupBy("label").agg(F.count("*").alias("weight")), "label").select("node", "label", "weight"), "weighed")


def joined_by_texts(placed: DataFrame, slim: DataFrame, words: int, radii: tuple[int, int] = (NEAR_RADIUS, FAR_RADIUS), least: float = SIMILAR, nearest: int = NEAREST, tile: int = TILE, longest: int = LONGEST, hashes: int = HASHES) -> DataFrame:
    """(node, label, weight): the components of all links between nodes that share a key and lie within the second radius, and whose texts have a similarity of least or more.

    placed: c and m (the key, that several rows share), node, n, pop and words. Links of a forest within the first
    radius go first. Then the rows that have candidates apart are dealt with their shingles' hashes, and each such
    candidate is confirmed, refused, or found joined by others."""
    fp = _words(words)
    each = placed.select("c", "m", "node", F.col("node").alias("label"), F.lit(1).cast("long").alias("weight"), "pop", "n", *fp)
    found = _by_blocks(_dealt(each, longest)).mapInArrow(_over_blocks(_nearest_links(radii[0], least, tile), words), "a long, b long")
    links = written(similar_links(found, slim, least=least), "similar")
    labels = _labelled(links)
    rows = placed.join(labels, "node", "left").select("c", "m", "node", F.coalesce("label", "node").alias("label"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight"), "pop", "n", *fp)
    apart = _by_blocks(_dealt(rows, longest)).mapInArrow(_over_blocks(_rows_apart(radii[1], least, tile), words), rows.schema)
    apart = written(apart.distinct(), "apart")
    texts = texts_of(slim, written(apart.select(F.col("node").alias("id")).distinct(), "needed"))
    sets = written(texts.mapInArrow(_hash_sets(NEAR_WIDTH), "node long, hashes binary"), "sets")
    dealt = _by_blocks(_dealt(apart, longest, hashes).join(sets, "node"))
    good = written(dealt.mapInArrow(_over_blocks(_joining(radii[1], least, tile, nearest), words), "a long, b long"), "joining")
    return labels if good.isEmpty() else _labelled(written(links.union(good), "links"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, **options) -> DataFrame:
    """(id, component_id): the smallest id of each group of near copies (five-word shingles, Jaccard similarity of least or more) for each other id in it.

    Texts that share the minima of a band (of 20 they miss all at a similarity of 0.8 once in 30,000 times) are joined if
    their similarity is confirmed; see ``joined_by_texts``. Null ids are in no group; rows of an id are one; texts
    without words are one group; an empty table has no groups."""
    names = _words(NEAR_WORDS)
    schema = f"id long, {', '.join(f'{w} long' for w in names)}, bands array<long>, n long"
    slim = _slim(docs, id_col, text_col).where("id is not null")
    each = written(slim.mapInArrow(_wide_fingerprints, schema), "wide")
    # equal fingerprints are one node; they meet by a key of their own if their bands differ
    nodes = written(each.groupBy(*names, "bands").agg(F.min("id").alias("node"), F.min_by("n", "id").alias("n")), "nodes")
    keys = nodes.select("node", F.posexplode(F.array_append("bands", F.xxhash64(*names))).alias("c", "m"))
    shared = written(keys.groupBy("c", "m").agg(F.count("*").alias("k")).where("k > 1").select("c", "m"), "shared")
    pop = sum((F.bit_count(w) for w in names[1:]), F.bit_count(names[0])).cast("int")
    placed = written(keys.join(shared, ["c", "m"]).join(nodes.select("node", *names, pop.alias("pop"), "n"), "node"), "placed")
    labels = joined_by_texts(placed, slim, NEAR_WORDS, least=least, **options).select("node", "label")
    members = each.join(nodes, [*names, "bands"]).select("id", "node")
    copies = members.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("component_id"))
    return copies.where("id <> component_id").groupBy("id").agg(F.min("component_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of near copies the document whose id is smallest, with all columns of docs.

    Rows of one id stay or go together; rows without an id stay."""
    gone = near_copies(docs, id_col, text_col, **options).select(F.col("id").alias(spare_name(docs, "gone")))
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(gone.columns[0]), "left_anti")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component; see ``near_dedup`` for nulls, empty and long texts, repeats and other columns."""
    found = near_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
