"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed greedily against
each automaton into phrases, each the longest match that occurs in the language's text; a
character that fits nowhere is a phrase of its own. The language that needs the fewest phrases per
character wins. Texts are lower-cased, runs of non-letters become one blank.

All automata lie in one transition table: a dense row per state for the ``LETTERS`` most frequent letters, and sorted
(state, letter) keys for the transitions by all others. Every letter of the sample counts. The table is bounded by the training sample: at most
``SAMPLE_CHARS`` characters over all languages, in excerpts of at most ``EXCERPT`` characters, from anywhere
in the training documents with the smallest hashed ids. Documents are parsed whole, in segments of
``SEGMENT`` characters so that many segments advance together; a cut adds at most one phrase to each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from textgrove.llm.common import crc_mod, fields, map_texts, plain_text
from textgrove.workspace import shuffle_tasks

SAMPLE_CHARS = 120_000
EXCERPT = 400
LETTERS = 62  # letters with a place in the dense rows; the transitions by others are looked up
SEGMENT = 1024
BATCH_CHARS = 4_000_000
SHARPNESS = 60.0  # phrases per character to log odds, for the score
BLANK, OTHER = 0, 1
UNDETERMINED = "und"


def suffix_automaton(ids: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (states, width), -1 where there is none, and those by ids from ``width`` on as rows
    (state, id, next); state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in ids:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(step), width), -1, np.int32)
    rare = []
    for state, following in enumerate(step):
        for c, after in following.items():
            if c < width:
                table[state, c] = after
            else:
                rare.append((state, c, after))
    return table, np.array(rare, np.int64).reshape(-1, 3)


class CrossParser:
    """Automata of several languages in one table.

    An entry is the next state, or ``~state`` where the match ends: the phrase is counted and the
    character starts the next one at that state.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = {name: " ".join(_plain(t) for t in samples[name]) for name in self.languages}
        chars, counts = np.unique(
            np.array([c for text in joined.values() for c in text if c != " "], dtype="U1"),
            return_counts=True,
        )
        ordered = chars[np.lexsort((chars, -counts))]
        self.letter = {str(c): i + 2 for i, c in enumerate(ordered)}
        self.kinds = len(self.letter) + 2
        self.width = min(self.kinds, LETTERS + 2)
        tables, roots, start, looked_up = [], [], 0, []
        for name in self.languages:
            ids = [BLANK if c == " " else self.letter[c] for c in joined[name]]
            table, rare = suffix_automaton(ids, self.width)
            looked_up.append(np.column_stack([(rare[:, 0] + start) * self.kinds + rare[:, 1], rare[:, 2] + start]))
            lone = len(table)  # the state of a phrase that is one unmatched character
            first = np.where(table[0] < 0, lone, table[0]) + start
            table = np.where(table < 0, ~first[None, :], table + start)
            table[0] = first  # nothing is open at the start, so nothing ends there
            tables.append(np.vstack([table, ~first]).astype(np.int32))
            roots.append(start)
            start += lone + 1
        self.table = np.concatenate(tables).reshape(-1) if tables else np.empty(0, np.int32)
        self.roots = np.array(roots, np.int32)
        rare = np.concatenate(looked_up) if looked_up else np.empty((0, 2), np.int64)
        rare = rare[np.argsort(rare[:, 0])]
        self.keys, self.nexts = rare[:, 0].copy(), rare[:, 1].astype(np.int32)

    def prepare(self) -> None:
        """Code point to class, made once in each worker."""
        if hasattr(self, "codes"):
            return
        points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        codes = np.full(0x110000, BLANK, np.int32)
        letters = np.array([ord(c) for c in points if c.isalpha()])
        codes[letters] = OTHER
        for c, i in self.letter.items():
            codes[ord(c)] = i
        self.codes = codes

    def classes(self, text: str) -> np.ndarray:
        ids = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        blank = ids == BLANK
        return ids[~(blank & np.concatenate(([True], blank[:-1])))]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per character (texts, languages), and which texts have a letter."""
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        lengths = np.zeros(len(texts), np.int64)
        lettered = np.zeros(len(texts), bool)
        held, owners, total = [], [], 0
        for i, text in enumerate(texts):
            ids = self.classes(text)
            lettered[i] = bool((ids != BLANK).any())
            lengths[i] = len(ids)
            for at in range(0, len(ids), SEGMENT):
                held.append(ids[at : at + SEGMENT])
                owners.append(i)
            total += len(ids)
            if total >= BATCH_CHARS:
                self._parse(held, owners, counts)
                held, owners, total = [], [], 0
        if held:
            self._parse(held, owners, counts)
        return counts / np.maximum(lengths, 1)[:, None], lettered

    def _parse(self, segments: list[np.ndarray], owners: list[int], counts: np.ndarray) -> None:
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        grid = np.zeros((sizes[0], len(order)), np.int32)
        for column, i in enumerate(order):
            grid[: len(segments[i]), column] = segments[i]
        # at step j the segments longer than j are a prefix
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        ended = np.zeros(state.shape, np.int32)
        for j in range(int(sizes[0])):
            n = int(active[j])
            place = state[:, :n] * np.int32(self.width)
            row = grid[j, :n]
            rare = np.flatnonzero(row >= self.width)
            place += np.where(row < self.width, row, OTHER)
            after = self.table.take(place)
            if len(rare):
                after[:, rare] = self._look_up(state[:, rare], row[rare], after[:, rare])
            fails = after < 0
            ended[:, :n] += fails
            np.copyto(state[:, :n], np.where(fails, ~after, after))
        # the phrase open at the end of a segment counts as well
        np.add.at(counts, np.array(owners)[order], ended.T + 1)


    def _look_up(self, state: np.ndarray, letters: np.ndarray, unmatched: np.ndarray) -> np.ndarray:
        """Entries for letters without a place in the dense rows; ``unmatched`` where a language lacks one."""

        def find(states):
            wanted = states.astype(np.int64) * self.kinds + letters
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            return self.keys[at] == wanted, self.nexts[at]

        on, after = find(state)
        starts, first = find(self.roots[:, None])
        return np.where(on, after, np.where(starts, ~first, unmatched))


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def training_sample(docs: DataFrame, fold: tuple[int, int], chars: int = SAMPLE_CHARS) -> dict:
    """Excerpts of labelled text by language, ``chars`` characters in all at most.

    ``docs`` has doc_id, text and lang. Rows whose crc32(id) modulo ``fold[0]`` is ``fold[1]`` are
    held out, rows without text or language are left out. Rows are ranked by a hash of id and text.
    """
    parts, held_out = fold
    usable = docs.filter(crc_mod("doc_id", parts) != held_out).filter(
        F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)
    )
    languages = usable.select("lang").distinct().count()
    if not languages:
        return {}
    share = max(1, chars // languages)
    most = min(1000, max(1, 4 * share // EXCERPT))
    order = F.xxhash64("doc_id", "excerpt"), "excerpt"
    # where an excerpt starts depends on a hash of the text, so that not only beginnings are learned
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - (EXCERPT - 1), F.lit(1))).cast("int") + 1
    excerpt = F.substring("text", start, F.lit(EXCERPT))
    rows = usable.select("doc_id", "lang", excerpt.alias("excerpt"))
    # first within salted parts of a language, so that the last rank sees a bounded number of rows
    salt = F.pmod(F.xxhash64("excerpt", "doc_id"), F.lit(shuffle_tasks(docs.sparkSession)))
    rows = rows.withColumn("salt", salt)
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= most)
    sample: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for row in rows.orderBy("lang", "rank").select("lang", "excerpt").toLocalIterator():
        text = row.excerpt[: share - held.get(row.lang, 0)]
        if text:
            sample.setdefault(row.lang, []).append(text)
            held[row.lang] = held.get(row.lang, 0) + len(text)
    return sample


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: tuple[int, int] = (4, 2),
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``.

    Learns from ``lang_col`` of rows whose crc32(id) modulo ``fold[0]`` is not ``fold[1]``; predicts
    from the text alone. ``score`` is the winner's share of the softmax of phrase rates. A text that
    is null or has no letter, and any text if nothing could be learned, gives ``und`` with score
    0. Equal rates go to the first language by name. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        plain_text(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    parser = CrossParser(training_sample(rows, fold, sample_chars))
    shared = rows.sparkSession.sparkContext.broadcast(parser)
    columns = fields(lang_pred=StringType(), score=DoubleType())

    def setup():
        shared.value.prepare()

        def make(texts):
            model = shared.value
            if not model.languages:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            rates, lettered = model.phrases(texts)
            best = rates.argmin(axis=1)
            weights = np.exp(-SHARPNESS * (rates - rates.min(axis=1)[:, None]))
            score = np.where(lettered, 1 / weights.sum(axis=1), 0.0)
            names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            return [names, score]

        return make

    kept = rows.select("doc_id", (crc_mod("doc_id", fold[0]) == fold[1]).alias("held_out"), "text")
    return map_texts(kept, columns, setup)
