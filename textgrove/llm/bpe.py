"""Byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the whole vocabulary
lists every token that occurs at every position of a pre-token in a single pass. The encoder takes
the longest match, keeps it if it is compatible with the token before it, falls back to the next
shorter match, and if none is left takes the token before back and closes that position for good.
A position is closed at most once, so the work is linear in the piece. Two tokens are compatible if
merging by rank over their joint bytes would never cross their border; the answer is memoised.
The result is exactly that of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from textgrove.llm.common import fields, map_arrow, map_texts, plain_text
from textgrove.llm.pretokens import PATTERN, splitter

MEMO = 200_000  # pieces, and token pairs, in each of the two generations a worker remembers


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Tokens by rank from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        ranked = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0 to n - 1")
    return [t for _, t in ranked]


def merge_parts(piece: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging by rank with ranks under ``below`` only; used to split each token once."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(tokens: list[bytes]) -> list[tuple[int, int]]:
    """The two tokens whose merge makes each token; (id, id) for a token no merge makes."""
    rank = {t: i for i, t in enumerate(tokens)}
    split = []
    for i, token in enumerate(tokens):
        parts = merge_parts(token, rank, i) if len(token) > 1 else [token]
        split.append((rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (i, i))
    return split


def prefixes(tokens: list[bytes]) -> list[int]:
    """For each token the longest shorter token it begins with, -1 if there is none."""
    rank = {t: i for i, t in enumerate(tokens)}
    cuts = ((rank.get(t[:n], -1) for n in range(len(t) - 1, 0, -1)) for t in tokens)
    return [next((i for i in cut if i >= 0), -1) for cut in cuts]


class Memo:
    """What was made for a key, up to a bounded number of keys.

    Two generations: when the young one is full it becomes the old one, and what is not asked for
    again before the next change is forgotten. ``get`` looks at the young generation alone.
    """

    def __init__(self, make, limit: int = MEMO):
        self.make, self.limit = make, limit
        self.young, self.old = {}, {}

    def learn(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class Encoder:
    """Encodes and decodes with the tokens of a rank file, their last merges and prefixes."""

    def __init__(
        self,
        tokens: list[bytes],
        split: list[tuple[int, int]],
        prefix: list[int],
        pattern: str = PATTERN,
    ):
        self.tokens, self.split, self.prefix = tokens, split, prefix
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.merged = {pair: i for i, pair in enumerate(split) if pair != (i, i)}
        self.length = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.fits = Memo(self._fits)
        self.pieces = Memo(lambda piece: tuple(self.encode_piece(piece.encode())))
        self.cut = splitter(pattern)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging by rank keeps the border between two adjacent tokens.

        The merges that made the two sides are undone from the latest back. A merge across the border
        would win if it exists and comes before the merges undone so far.
        """
        left, right = pair
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    inner = self.split[left][1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.split[right][0]
                    if inner != right:
                        # an equal merge on the right comes after one that starts further left
                        limit, right = right + 1, inner
                        break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, length, prefix = len(piece), self.length, self.prefix
        known, learn = self.fits.young.get, self.fits.learn
        longest = [0] * n  # at each start; later matches of a start are longer
        for end, (token, inside) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - inside] = token
        closed = bytearray(n + 1)
        out: list[int] = []
        pos, token, before = 0, longest[0], -1
        while True:
            while token >= 0:
                end = pos + length[token]
                if not closed[end]:
                    if before < 0:
                        break
                    pair = (before, token)
                    fits = known(pair)
                    if fits is None:
                        fits = learn(pair)
                        known = self.fits.young.get
                    if fits:
                        break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                pos, before, token = end, token, longest[end]
            else:
                closed[pos] = 1
                token = out.pop()
                pos -= length[token]
                token = prefix[token]
                before = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, learn, extend = self.pieces.young.get, self.pieces.learn, ids.extend
        for piece in self.cut(text):
            found = known(piece)
            if found is None:
                found = learn(piece)
                known = self.pieces.young.get
            extend(found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def _encoded(docs: DataFrame, ranks_path: str, columns: StructType, rows) -> DataFrame:
    """``docs`` with ``text`` replaced by ``columns``; ``rows`` makes their values from texts."""
    spark = docs.sparkSession
    tokens = read_ranks(spark, ranks_path)
    name = hashlib.sha256(b"\n".join(tokens)).hexdigest()
    model = spark.sparkContext.broadcast((tokens, last_merges(tokens), prefixes(tokens)))  # bounded by the rank file

    def setup():
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(*model.value)
        return lambda texts: rows(_encoders[name], texts)

    return map_texts(docs, columns, setup)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int), one row per row of ``docs``; null and empty texts: no ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))

    def make(encoder, texts):
        return [[encoder.encode(t) for t in texts]]

    return _encoded(rows, ranks_path, fields(ids=ArrayType(IntegerType(), False)), make)


def decode(ids: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``ids`` with ``text``, the decoded text (bytes that are not UTF-8 become U+FFFD).

    A null array gives a null text. An id outside the vocabulary is an error.
    """
    spark = ids.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    schema = StructType(ids.schema.fields + fields(text=StringType()).fields)

    def run(batches):
        for batch in batches:
            texts = [
                None if row is None else b"".join(tokens.value[i] for i in row).decode("utf-8", "replace")
                for row in batch.column(ids_col).to_pylist()
            ]
            names = [*batch.schema.names, "text"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return map_arrow(ids, run, schema)


def round_trip(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over the decimal ids joined by one blank, ``decoded_sha256`` over the decoded
    bytes. ``with_ids`` adds the ids. Null and empty texts have 0 tokens and digests of nothing. One
    row per row of ``docs``, repeated or not; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    columns = fields(n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType())
    if with_ids:
        columns = columns.add("ids", ArrayType(IntegerType(), False))

    def make(encoder, texts):
        words = [str(i) for i in range(len(encoder.tokens))]
        out: list[list] = [[] for _ in columns.fields]
        for text in texts:
            ids = encoder.encode(text)
            written = " ".join(map(words.__getitem__, ids)).encode()
            row = (
                len(ids),
                hashlib.sha256(written).hexdigest(),
                hashlib.sha256(encoder.decode(ids)).hexdigest(),
                ids,
            )
            for column, value in zip(out, row):
                column.append(value)
        return out

    return _encoded(rows, ranks_path, columns, make)
