"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Every prefix of a text has one encoding, so one last token. The table stores it for each prefix: of the vocabulary
pieces that an Aho-Corasick automaton finds to end there, it is the one that fits the last token of the prefix it
leaves, as the two stay apart when their joined text is merged. The ids are then recovered from the end backwards.

Merges never cross a place that no piece spans: before a space mark that follows another character, or at a
character that is in no piece (it becomes bytes). Texts are cut there and short cuts are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents
from .slices import sliced

MARK = "▁"
#: Bounds of what half a memo remembers: cuts of either kind and their length (some 45 MB each), and pairs of tokens (some 15 MB).
KEPT_CUTS, LONGEST_CUT, KEPT_PAIRS = 1 << 17, 48, 1 << 17


class _Memo(dict):
    """Computes what it lacks. When full it becomes the old half, from which what is still asked for comes back."""

    def __init__(self, made, kept: int, longest: int | None = None):
        super().__init__()
        self.made, self.kept, self.longest, self.old = made, kept, longest, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.made(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.kept:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


class PieceTokens:
    """proto: a serialized model of type BPE with byte fallback, identity normalisation and a dummy prefix; others are refused."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent, self.unknown = {i for i in range(n) if sp.is_control(i)}, sp.unk_id()
        usual = [i for i in range(n) if not (i in self.byte_of or i in self.silent or i == self.unknown)]
        self.id_of, self.score = {self.piece[i]: i for i in usual}, {i: sp.get_score(i) for i in usual}
        lone = {c for p in self.id_of for c in p} - self.id_of.keys()
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        if len(self.byte_id) != 256 or any(sp.is_unused(i) for i in range(n)) or lone or crossing:
            raise ValueError("only BPE models with byte fallback, whose pieces have a space mark in front at most, are supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.size = {i: len(p) for p, i in self.id_of.items()}
        #: What a token decodes to by itself; tokens of bytes don't.
        self.shown = [None if i in self.byte_of else "" if i in self.silent else " ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.piece)]
        self.fits = _Memo(self._fits, KEPT_PAIRS)
        self.cut, self.after_space = _Memo(self._cut, KEPT_CUTS, LONGEST_CUT), _Memo(lambda w: self._cut(MARK + w), KEPT_CUTS, LONGEST_CUT)
        self.breaks = "\n" if "\n" not in self.id_of else None
        for text in ("", " ", "a", " a  b\n\n c ", f"x{MARK} y", "Hello, wörld!\r\n\t日本\U0001f600\x00z"):
            if self.encode(text) != sp.encode(text) or self.decode(self.encode(text)) != sp.decode(sp.encode(text)):
                raise ValueError("the model's normalisation is not supported")

    def merged(self, text: str) -> list[int]:
        """By merging: of adjacent symbols that make a piece, the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.id_of[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: int) -> bool:
        """pair: (left + 1) * 2^20 + right, where left is -1 at a cut."""
        left, right = (pair >> 20) - 1, pair & 0xFFFFF
        if left < 0:
            return self.merged(self.piece[right]) == [right]
        return self.merged(self.piece[left] + self.piece[right]) == [left, right]

    def table(self, text: str) -> list[int]:
        """For each prefix, the last token of its encoding, or -1 if it ends in a character of no piece."""
        last, fits = [-1] * (len(text) + 1), self.fits
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0 and fits[(last[end - size] + 1 << 20) + token]:
                last[end] = token
        return last

    def ids(self, text: str) -> list[int]:
        """Of a text with space marks."""
        last, i, out = self.table(text), len(text), []
        while i:
            token = last[i]
            if token < 0:
                out += [self.byte_id[b] for b in reversed(text[i - 1].encode())]
                i -= 1
            else:
                out.append(token)
                i -= self.size[token]
        return out[::-1]

    def _cut(self, text: str) -> tuple[str, str]:
        ids = self.ids(text)
        return ",".join(map(str, ids)), self._joined(ids)

    def _cuts(self, text: str) -> list[tuple[str, str]]:
        """(ids, decoded text with a space for the dummy prefix) of what text is cut to."""
        if not text:
            return []
        if MARK in text:
            return [self.cut[x] for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))]
        out, lines = [], f" {text}".split(self.breaks) if self.breaks else [f" {text}"]
        for k, line in enumerate(lines):
            if k:
                out.append(self.cut[self.breaks])
            first, *words = line.split(" ")
            if "" in words:
                out += [self.cut[x] for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK))]
                continue
            if first:
                out.append(self.cut[first])
            out += map(self.after_space.__getitem__, words)
        return out

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """The ids, joined by commas, and the text that they decode to."""
        cuts = self._cuts(text or "")
        return ",".join([x for x, _ in cuts]), "".join([x for _, x in cuts])[1:]

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_text(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def _joined(self, ids: list[int]) -> str:
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            while held:  # a character, or a mark for a byte that starts none
                for n in range(1, 5):
                    try:
                        out.append(held[:n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    n = 1
                del held[:n]
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int] | None) -> str:
        """One space mark at the start goes, as the dummy prefix."""
        shown = [i for i in ids or [] if i not in self.silent]
        text = self._joined(shown)
        return text[1:] if shown and shown[0] in self.id_of.values() and self.piece[shown[0]].startswith(MARK) else text


_LOADED: dict[bytes, PieceTokens] = {}


def _tokens(proto: bytes) -> PieceTokens:
    """Kept by a worker from one task to the next."""
    key = hashlib.sha256(proto).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceTokens(proto)
    return _LOADED[key]


def _model(path: str) -> bytes:
    """A vocabulary file, of a few MB at most whatever the corpus; it goes to the tasks with their code."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array in place of the text. A null text has none, like an empty one."""
    proto, rest = _model(model), [c for c in docs.columns if c != text_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(proto)
        for batch in sliced(batches, len(rest)):
            ids = pa.array([tokens.encode(x) for x in batch.column(len(rest)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*rest, ids_col])

    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string"))
    return slim.mapInArrow(task, T.StructType([*slim.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with the text of each array of ids in place of the ids."""
    proto, rest = _model(model), [c for c in coded.columns if c != ids_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(proto)
        for batch in batches:
            texts = pa.array([tokens.decode(x) for x in batch.column(len(rest)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*rest, text_col])

    slim = coded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids_col}`"))
    return slim.mapInArrow(task, T.StructType([*slim.schema.fields[:-1], T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, and digests of its ids and of the text that they decode to.

    A null text counts as empty: no tokens, the digests of nothing. Long texts are encoded whole. Repeated rows and
    null ids are rows of their own, an empty table gives an empty one, and other columns are not read."""
    proto = _model(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(proto)
        for batch in sliced(batches, 1):
            pairs = [tokens.encode_text(x) for x in batch.column(1).to_pylist()]
            columns = [
                pa.array([x.count(",") + 1 if x else 0 for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in pairs]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in pairs]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(task, slim.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents encoded and decoded; see ``round_trip`` for nulls, empty and long texts, repeats and other columns."""
    return round_trip(documents(spark, sf_dir), public_model())
