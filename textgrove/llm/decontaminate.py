"""Benchmark decontamination by word windows.

Words are lower-cased runs of digits, letters and everything beyond ASCII. A window is ``size``
consecutive words of a benchmark item; an item of fewer words is one window. All distinct windows
form a hash set sent to every task. A task turns the words of its documents into numbers of the
benchmark's vocabulary, hashes all token windows at once, and verifies hits word by word.

The set is broadcast in parts of at most ``max_windows`` windows. A benchmark above that is cut into
parts by item; each part is scanned and the marked spans are united per document.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from textgrove.llm.common import fields, map_arrow, map_texts, plain_text
from textgrove.workspace import Workspace

SIZE = 10
MAX_WINDOWS = 1_000_000  # about 100 MB in a task
# Every ASCII byte but digits and letters separates words; A-Z become a-z.
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_UPPER = bytes(range(0x41, 0x5B))
NORMAL = bytes(b + 32 if b in _UPPER else b if b in _WORD else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Windows:
    """The windows of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = SIZE):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for i in range(max(1, len(ids) - size + 1)) if ids else ():
                found[tuple(ids[i : i + size])].add(item_id)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        hashed: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for window, owners in found.items():
            value = int(_hashes(np.array(window, np.int64), len(window))[0])
            hashed[len(window)][value].append((window, owners))
        for length, table in hashed.items():
            self.by_length[length] = (np.array(sorted(table), np.uint64), dict(table))

    def spans(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, set]]]]:
        """For each text its number of words and the verified hits (first word, length, items)."""
        known = self.vocabulary.get
        lists = [[known(w, -1) for w in words_of(t)] for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        starts = np.cumsum(sizes) - sizes
        joined = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
        hits: list[list] = [[] for _ in texts]
        unknown = np.concatenate(([0], np.cumsum(joined < 0)))
        for length, (values, table) in self.by_length.items():
            if len(joined) < length:
                continue
            # only windows of known words alone are hashed
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            hashes = _hashes(joined, length, at)
            place = np.searchsorted(values, hashes)
            place[place == len(values)] = 0
            same = values[place] == hashes
            for i, value in zip(at[same].tolist(), hashes[same].tolist()):
                doc = int(np.searchsorted(starts, i, side="right")) - 1
                first = i - int(starts[doc])
                if first + length > sizes[doc]:
                    continue
                window = tuple(joined[i : i + length].tolist())
                for candidate, owners in table[value]:
                    if candidate == window:
                        hits[doc].append((first, length, owners))
        return list(zip(sizes.tolist(), hits))


def _hashes(ids: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    at = np.arange(len(ids) - length + 1) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = out * BASE + ids[at + k].astype(np.uint64) + np.uint64(1)
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching (first, length) spans united, as sorted (first, end)."""
    out: list[list[int]] = []
    for first, length in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + length)
        else:
            out.append([first, first + length])
    return [tuple(x) for x in out]


def _item_parts(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int):
    """Items as (id text, text) lists of at most ``limit`` windows each, or of one item."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), plain_text(text_col).alias("text"))
    part, windows = [], 0
    for id_text, text in rows.toLocalIterator():
        more = max(1, len(words_of(text)) - size + 1)
        if part and windows + more > limit:
            yield part
            part, windows = [], 0
        part.append((id_text, text))
        windows += more
    yield part


def _scan(rows: DataFrame, items: list, size: int) -> DataFrame:
    """``rows`` with n_words, spans (first, end) and items instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    span = StructType().add("first", LongType()).add("end", LongType())
    columns = fields(
        n_words=LongType(), spans=ArrayType(span, False), items=ArrayType(StringType(), False)
    )

    def setup():
        windows = Windows(shared.value, size)

        def make(texts):
            found = windows.spans(texts)
            spans = [[{"first": a, "end": b} for a, b in covered([h[:2] for h in x])] for _, x in found]
            items = [
                sorted({i for _, _, owners in x for i in owners if i is not None}) for _, x in found
            ]
            return [[n for n, _ in found], spans, items]

        return make

    return map_texts(rows, columns, setup)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``doc_id, n_words, spans, items``, one row per row of ``docs``.

    ``spans`` are the united (first, end) word ranges that lie in occurrences of benchmark windows,
    ``items`` the ids (as text, sorted) of the items with such an occurrence. Null and empty texts have
    no words and hit nothing; items without words are ignored, items without an id mark spans
    only, items that share an id count once. Repeated rows stay. Empty tables: no rows, or no hits.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    parts = _item_parts(benchmark, item_col, item_text_col, size, max_windows)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan(rows, first, size)
    work = Workspace(docs.sparkSession)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    scans = [
        work.write(_scan(rows, part, size), f"part_{k}")
        for k, part in enumerate(chain([first, second], parts))
    ]
    united = scans[0]
    for scan in scans[1:]:
        united = united.unionByName(scan)
    found = united.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches):
        for batch in batches:
            spans = [
                [{"first": a, "end": b} for a, b in covered([(s["first"], s["end"] - s["first"]) for s in x])]
                for x in batch.column("spans").to_pylist()
            ]
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, batch.schema.field(at), pa.array(spans, batch.schema.field(at).type))

    found = found.drop("row")
    return map_arrow(found, unite, found.schema)


def digest(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (ids comma-joined) and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, windows: Windows) -> str | None:
    """``text`` without the words in hit spans and what separates them; None if nothing is hit."""
    [(_, hits)] = windows.spans([text])
    if not hits:
        return None
    raw = text.encode()
    plain = raw.translate(NORMAL)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for first, end in covered([h[:2] for h in hits]):
        out.append(raw[done : places[first][0]])
        done = places[end][0] if end < len(places) else len(raw)
    return b"".join([*out, raw[done:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_col: str = "text",
    size: int = SIZE,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` with its columns, cleaned of benchmark windows.

    ``documents`` drops every document that is hit; ``spans`` keeps it and cuts the hit words out of
    its text. Documents that are not hit, null and empty texts included, stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    at = docs.columns.index(text_col)
    for part in _item_parts(benchmark, "item_id", "text", size, max_windows):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            windows = Windows(shared.value, size)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                if mode == "documents":
                    clean = [not hits for _, hits in windows.spans([t or "" for t in texts])]
                    yield batch.filter(pa.array(clean, pa.bool_()))
                else:
                    cut = [t and cut_spans(t, windows) for t in texts]
                    texts = [t if c is None else c for t, c in zip(texts, cut)]
                    column = pa.array(texts, batch.schema.field(at).type)
                    yield batch.set_column(at, batch.schema.field(at), column)

        docs = map_arrow(docs, run, docs.schema)
    return docs
