"""Exact dedup by Patricia tries that own texts.

Rows are dealt by text length and content hash. Each task inserts the full byte strings into a compressed
radix trie whose terminal nodes hold the smallest identifier seen; texts are the same only if every byte is.
A trie that outgrows its memory bound spills: each subtree below the first fork goes to a file of its own,
and is read back and owned alone.

A first pass builds one trie in every input task, so a text that fills a third of the table leaves a task once;
only these local owners carry text through the shuffle. A second pass finds the owner among local owners.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, spare_name, written
from .slices import sliced

#: Bytes of text, rows and nodes that a task's trie holds before it spills, and what a node counts for.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400


class _Node:
    """The edge label above a node is key[parent.end:end]. owner: (no_id, rank, rid, size, batch, row) of a terminal."""

    __slots__ = ("key", "end", "kids", "owner", "spill")

    def __init__(self, key: bytes, end: int):
        self.key, self.end, self.kids, self.owner, self.spill = key, end, {}, None, None


class _Spill:
    """Rows of one spilled subtree, in an Arrow file of the task's own temporary folder."""

    def __init__(self, folder: str, schema: pa.Schema):
        fd, self.path = tempfile.mkstemp(dir=folder, suffix=".arrow")
        os.close(fd)
        self.sink = pa.OSFile(self.path, "wb")
        self.out = pa.ipc.new_stream(self.sink, schema)

    def read(self) -> Iterator[pa.RecordBatch]:
        self.out.close()
        self.sink.close()
        with pa.memory_map(self.path) as source:
            yield from pa.ipc.open_stream(source)
        os.unlink(self.path)


def _first_difference(a: bytes, b: bytes, low: int, high: int) -> int:
    """The first position from low on where a and b differ, given that they do before high."""
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Trie:
    def __init__(self, limit: int, folder: str, schema: pa.Schema):
        self.limit, self.folder, self.schema = limit, folder, schema
        self.root, self.batches, self.held = _Node(b"", 0), [], 0

    def node(self, key: bytes) -> _Node:
        """The terminal node of key, or the spilled subtree that holds it."""
        at, pos, n = self.root, 0, len(key)
        while True:
            if at.spill or pos == n:
                return at
            kid = at.kids.get(key[pos])
            if kid is None:
                at.kids[key[pos]] = leaf = _Node(key, n)
                self.held += n + NODE_BYTES
                return leaf
            end = min(kid.end, n)
            if kid.key[pos:end] != key[pos:end]:
                end = _first_difference(kid.key, key, pos, end)
            elif end == kid.end:
                at, pos = kid, end
                continue
            self.held += NODE_BYTES
            fork = _Node(kid.key, end)
            fork.kids[kid.key[end]] = kid
            at.kids[key[pos]] = fork
            at, pos = fork, end

    def spill(self) -> None:
        """Moves every subtree below the first fork to its file; what lies above keeps its rows."""
        fork = self.root
        while len(fork.kids) == 1 and not fork.spill:
            fork = next(iter(fork.kids.values()))
        if len(fork.kids) < 2:
            return
        for kid in fork.kids.values():
            below = list(_below(kid))
            rows = [node.owner for node in below if node.owner]
            # a fork made above subtrees that were spilled before takes over their files
            first, *others = [node.spill for node in below if node.spill] or [_Spill(self.folder, self.schema)]
            kid.spill = first
            for other in others:
                for batch in other.read():
                    first.out.write_batch(batch)
            if rows:
                kid.spill.out.write_batch(self.rows(rows))
            kid.key, kid.kids, kid.owner = bytes(kid.key[: kid.end]), {}, None
        left = [node for node in _below(self.root) if node.owner]
        batch = self.rows([node.owner for node in left]) if left else None
        for i, node in enumerate(left):
            node.owner = (*node.owner[:4], 0, i)
        self.batches = [batch] if left else []
        self.held = batch.nbytes if left else 0

    def rows(self, owners: list[tuple]) -> pa.RecordBatch:
        """The rows of owners, with the sizes of their groups so far."""
        by_batch: dict[int, list[tuple]] = {}
        for x in owners:
            by_batch.setdefault(x[4], []).append(x)
        ordered = [x for group in by_batch.values() for x in group]
        parts = [self.batches[b].take(pa.array([x[5] for x in group], pa.int32())) for b, group in by_batch.items()]
        table = pa.Table.from_batches(parts, self.schema).combine_chunks()
        sizes = pa.array([x[3] for x in ordered], pa.int64())
        batch = table.set_column(self.schema.get_field_index("size"), self.schema.field("size"), sizes).to_batches()[0]
        at = {x[4:]: i for i, x in enumerate(ordered)}
        return batch.take(pa.array([at[x[4:]] for x in owners], pa.int32()))


def _below(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += node.kids.values()


def own(batches: Iterator[pa.RecordBatch], limit: int = TRIE_BYTES) -> Iterator[tuple[pa.RecordBatch | None, dict]]:
    """(owner rows, none) and (None, copies), in turns. copies: by the rid of a row, the rid of an equal one with a smaller identifier, and no_id and rank of its own.

    Columns of a batch: rid, no_id, rank, size, key and any others. Sizes add up in the owner's row."""
    with tempfile.TemporaryDirectory() as folder:
        yield from _own(batches, limit, folder)


def _own(batches: Iterator[pa.RecordBatch], limit: int, folder: str) -> Iterator[tuple[pa.RecordBatch | None, dict]]:
    trie, copies = None, {}
    for batch in sliced(batches, "key"):
        trie = trie or _Trie(limit, folder, batch.schema)
        slot, fresh, apart = len(trie.batches), [], {}
        columns = (batch.column(c).to_pylist() for c in ("no_id", "rank", "rid", "size", "key"))
        for i, (no_id, rank, rid, size, key) in enumerate(zip(*columns)):
            node = trie.node(key)
            if node.spill:
                apart.setdefault(id(node), (node.spill, []))[1].append(i)
                continue
            was = node.owner
            if was is None:
                node.owner = (no_id, rank, rid, size, slot, i)
                fresh.append(node)
            elif (no_id, rank, rid) < was[:3]:
                copies[was[2]] = (rid, *was[:2])
                node.owner = (no_id, rank, rid, was[3] + size, slot, i)
                fresh.append(node)
            else:
                copies[rid] = (was[2], no_id, rank)
                node.owner = (*was[:3], was[3] + size, *was[4:])
        for spill, rows in apart.values():
            spill.out.write_batch(batch.take(pa.array(rows, pa.int32())))
        keep = {node.owner[5]: node for node in fresh if node.owner and node.owner[4] == slot}
        if keep:
            for at, node in enumerate(keep.values()):
                node.owner = (*node.owner[:5], at)
            trie.batches.append(batch.take(pa.array(list(keep), pa.int32())))  # a copy: a slice would keep its whole batch
            trie.held += trie.batches[-1].nbytes
        if trie.held > limit:
            trie.spill()
    if trie is None:
        return
    nodes = list(_below(trie.root))
    owners = [node.owner for node in nodes if node.owner]
    for i in range(0, len(owners), 500):
        yield trie.rows(owners[i : i + 500]), {}
    yield None, copies
    spills, trie = [node.spill for node in nodes if node.spill], None
    del nodes, owners
    for spill in spills:
        yield from _own(spill.read(), limit, folder)


def _pass(limit: int, out: pa.Schema):
    """For mapInArrow: every row with its owner; key and payload, where out has them, only in the owner's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, tuple] = {}
        # by the owner's rid: owner_no_id, owner_rank, size, sha256
        about: dict[int, tuple] = {}

        def made(n: int, columns: dict) -> pa.RecordBatch:
            arrays = [x if isinstance(x := columns.get(f.name) or [None] * n if not isinstance(columns.get(f.name), pa.Array) else columns[f.name], pa.Array) else pa.array(x, f.type) for f in out]
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for rows, copies in own(batches, limit):
            if rows is None:
                parent |= copies
                continue
            columns = {f.name: rows.column(f.name) for f in out if f.name in rows.schema.names}
            columns |= {"owner_rid": rows.column("rid"), "owner_no_id": rows.column("no_id"), "owner_rank": rows.column("rank")}
            columns["sha256"] = [hashlib.sha256(k).hexdigest() for k in rows.column("key").to_pylist()] if "sha256" in out.names else [None] * rows.num_rows
            for rid, *rest in zip(*(rows.column(c).to_pylist() for c in ("rid", "no_id", "rank", "size")), columns["sha256"]):
                about[rid] = rest
            yield made(rows.num_rows, columns)
        copied = list(parent)
        for i in range(0, len(copied), 10_000):
            part, columns = copied[i : i + 10_000], {f.name: [] for f in out}
            for rid in part:
                top = rid
                while up := parent.get(top):
                    top = up[0]
                for name, x in zip(("rid", "no_id", "rank", "owner_rid", "owner_no_id", "owner_rank", "size", "sha256"), (rid, *parent[rid][1:], top, *about[top])):
                    if name in columns:
                        columns[name].append(x)
            yield made(len(part), columns)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(*more: T.StructField) -> T.StructType:
    named = [T.StructField(c, T.BooleanType() if "no_id" in c else T.LongType()) for c in ("rid", "no_id", "rank", "owner_rid", "owner_no_id", "owner_rank", "size")]
    return T.StructType([*named, *more])


class ExactDedup:
    """Owners of equal texts in docs.

    keep: "max" or "min", the id that stays. Null texts count as empty; long texts are compared whole. A null id loses
    to any other; among rows with the same text and id, one stays. Repeated rows are rows of their own. Ids are
    whole numbers (or null). Other columns pass through, whatever their names; an empty table gives an empty one.

    What a trie spills goes to a temporary folder of the task: only the same attempt reads it, and a task that is
    lost makes it anew."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", limit: int = TRIE_BYTES, rows: bool = False):
        self.id_col, self.limit = id_col, limit
        self.flip = (lambda c: F.bitwise_not(c)) if keep == "max" else (lambda c: c)
        ident, self.id_type = F.col(f"`{id_col}`"), docs.schema[id_col].dataType
        if keep not in ("max", "min"):
            raise ValueError("keep is max or min")
        self.null_text = spare_name(docs, "no_text")
        others = [c for c in docs.columns if c != text_col] if rows else []
        self.order, self.text_col = docs.columns, text_col
        slim = docs.select(
            F.monotonically_increasing_id().alias("rid"),
            ident.isNull().alias("no_id"),
            F.coalesce(self.flip(ident.cast("long")), F.lit(0)).alias("rank"),
            F.lit(1).cast("long").alias("size"),
            F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("key"),
            F.struct(F.col(f"`{text_col}`").isNull().alias(self.null_text), *[F.col(f"`{c}`") for c in others]).alias("payload"),
        )
        payload = T.StructType([T.StructField(f.name, f.dataType) for f in slim.schema["payload"].dataType])  # copies have none
        self.first_schema = _schema(T.StructField("key", T.BinaryType()), T.StructField("payload", payload))
        first = slim.mapInArrow(_pass(limit, _arrow(self.first_schema)), self.first_schema)
        self.local = written(first, "local_owners")

    def _second(self, rows: bool) -> DataFrame:
        """Local owners with their owner among all."""
        dealt = self.local.where("key is not null").select("rid", "no_id", "rank", "size", "key", *["payload"] * rows)
        dealt = dealt.withColumns({"n": F.length("key"), "h": F.xxhash64("key")}).repartition("n", "h").drop("n", "h")
        schema = self.first_schema if rows else _schema(T.StructField("sha256", T.StringType()))
        return dealt.mapInArrow(_pass(self.limit, _arrow(schema)), schema)

    def assignments(self) -> DataFrame:
        """A row for each document: its id, keep_id, group_size, kept, text_sha256."""
        second = self._second(False).drop("no_id", "rank").withColumnRenamed("rid", "local_rid").withColumnRenamed("owner_rid", "top")
        members = self.local.select("rid", F.col("owner_rid").alias("local_rid"), "no_id", "rank")
        name = F.when(~F.col("no_id"), self.flip(F.col("rank"))).cast(self.id_type)
        return members.join(second, "local_rid").select(
            name.alias(self.id_col),
            F.when(~F.col("owner_no_id"), self.flip(F.col("owner_rank"))).cast(self.id_type).alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("rid") == F.col("top")).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of docs."""
        second = self._second(True).where("rid = owner_rid")
        text = F.when(~F.col(f"payload.`{self.null_text}`"), F.col("key").cast("string"))
        return second.select(*[text.alias(c) if c == self.text_col else F.col(f"payload.`{c}`") for c in self.order])


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: its id, keep_id, group_size, kept and text_sha256; see ``ExactDedup``."""
    return ExactDedup(docs, **options).assignments()


def keep_distinct(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns; see ``ExactDedup``."""
    return ExactDedup(docs, rows=True, **options).kept()


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays for its text, the one with the largest doc_id; see ``ExactDedup`` for nulls and ties."""
    return exact_dedup(documents(spark, sf_dir), keep="max")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
