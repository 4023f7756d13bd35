"""Benchmark decontamination: rare n-gram seeds, exact bounds, then Smith-Waterman alignment of words.

Which seeds suffice follows from the least score. An alignment of ``M`` matches
and ``E`` errors has at most ``E + 1`` runs of matches, so at least ``M - E - 1``
pairs of neighbouring words of the item survive: its score less one. Of the
item's ``m - 1`` pairs any ``m - score + 1`` then hold a surviving one, and the
rarest such pairs are taken as seeds. No leak is lost, however rare the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.texts import PlacedHasher, lean, text_views
from pairweave.session import discard, materialize

SEED_WORDS = 2
LEAST_SCORE = 0.5  # alignment score of a leak, as a share of the item's words
MATCH, MISMATCH, GAP = 1, -1, -1
BLOCK_WORDS = 1 << 20  # benchmark words held by a task at once; more items make more blocks


def leak_hasher() -> PlacedHasher:
    """Words between blanks and ASCII punctuation: edits of punctuation change nothing."""
    hasher = PlacedHasher()
    hasher.blank[[i for i in range(128) if not chr(i).isalnum()]] = True
    return hasher


def lowered(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """Bytes of the lower-cased texts: edits of case change nothing either."""
    return text_views(pc.utf8_lower(texts))


def grams(words: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
    """Hash of each full run of ``size`` words; nothing for a shorter text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[k : n + k]
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and the first and last word of ``words`` it spans.

    One vector step per item word; gaps along ``words`` are a running maximum.
    """
    n = len(words)
    steps = np.arange(n) * GAP
    score, start = np.zeros(n, np.int64), np.arange(n)
    best = (0, 0, 0)
    for w in item:
        before, before_start = np.concatenate([[0], score[:-1]]), np.concatenate([[0], start[:-1]])
        fresh = before == 0
        diagonal = before + np.where(words == w, MATCH, MISMATCH)
        origin = np.where(fresh, np.arange(n), before_start)
        up = score + GAP
        cell = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, origin, start)
        lifted = cell - steps
        run = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == run, np.arange(n), 0))
        score, start = np.maximum(run + steps, 0), origin[came]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``first[i]``, ``first[i] + 1``, ... for ``many[i]`` numbers, one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


class Keys:
    """Distinct hashes with a sieve, so that most others are told apart without a search."""

    def __init__(self, hashes: np.ndarray):
        self.all = np.unique(hashes)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.all >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``found`` that hold a key, and which one."""
        at = np.flatnonzero(self.sieve[(found >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.all, found[at]), len(self.all) - 1)
        same = self.all[key] == found[at]
        return at[same], key[same]


class Block:
    """Benchmark items as flat arrays, small enough to send to every task."""

    def __init__(self, ids: list[int], texts: list[str], least: float = LEAST_SCORE):
        hasher = leak_hasher()
        self.ids = ids
        self.items = [hasher.words(v) if v is not None else np.zeros(0, np.uint64) for v in lowered(pa.array(texts, pa.string()))]
        flat = np.concatenate([*self.items, np.zeros(0, np.uint64)])
        self.length = np.array([len(w) for w in self.items], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.vocabulary = Keys(flat)
        self.word = np.searchsorted(self.vocabulary.all, flat)
        # two words at least, and the whole of a shorter item
        self.need = np.ceil(np.maximum(least * self.length / MATCH - 1e-9, np.minimum(self.length, 2))).astype(np.int64)
        singles = np.flatnonzero(self.length == 1)
        self.single_words = Keys(np.array([self.items[i][0] for i in singles], np.uint64))
        self.singles: dict[int, list[int]] = {}
        for i in singles.tolist():
            self.singles.setdefault(int(np.searchsorted(self.single_words.all, self.items[i][0])), []).append(i)
        pairs = [grams(w) for w in self.items]
        common, held = np.unique(np.concatenate([*map(np.unique, pairs), np.zeros(0, np.uint64)]), return_counts=True)
        # the rarest pairs of each item, in the order of its words
        places = []
        for i, own in enumerate(pairs):
            enough = int(self.length[i] - self.need[i] + 1)
            rare = np.argsort(held[np.searchsorted(common, own)], kind="stable")
            places.append(np.sort(rare[:enough]))
        self.place = np.concatenate([*places, np.zeros(0, np.int64)])
        gram = np.concatenate([*[g[p] for g, p in zip(pairs, places, strict=True)], np.zeros(0, np.uint64)])
        self.seeds = Keys(gram)
        self.kind = np.searchsorted(self.seeds.all, gram)  # an item's seeds stand together
        self.n_seeds = np.array([len(p) for p in places], np.int64)
        self.first_seed = np.cumsum(self.n_seeds) - self.n_seeds
        # the items of each kind of seed
        item = np.repeat(np.arange(len(ids)), self.n_seeds)
        order = np.argsort(self.kind, kind="stable")
        self.holder = item[order]
        self.holders = np.bincount(self.kind, minlength=len(self.seeds.all))
        self.first_holder = np.cumsum(self.holders) - self.holders

    def candidates(self, kinds: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Items with one of the seeds of which enough words are ``present``, those with most seeds first."""
        items, shared = np.unique(self.holder[ranges(self.first_holder[kinds], self.holders[kinds])], return_counts=True)
        m = self.length[items]
        occur = np.add.reduceat(present[self.word[ranges(self.begin[items], m)]].astype(np.int64), np.cumsum(m) - m)
        enough = occur >= self.need[items]  # no alignment can score more than the words that occur
        return items[enough][np.argsort(-shared[enough], kind="stable")]


def leaks_in(block: Block, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """``(item, score, first word, last word)`` of every item that the text leaks.

    However frequent a seed is, each place of it is followed up; only places
    that cannot reach the least score by the words around them are left out.
    """
    place, which = block.single_words.hits(words) if block.singles else ((), ())
    for key, first in dict(zip(reversed(which), reversed(place), strict=True)).items():
        for i in block.singles[int(key)]:
            yield i, 1.0, int(first), int(first)
    at, kind = block.seeds.hits(grams(words))
    if not len(at):
        return
    order = np.argsort(kind, kind="stable")
    at, kind = at[order], kind[order]
    known, which = block.vocabulary.hits(words)
    present = np.zeros(len(block.vocabulary.all), bool)
    present[which] = True
    own = np.zeros(len(present), bool)
    for i in block.candidates(np.unique(kind), present):
        item, m, need, best = block.items[i], int(block.length[i]), int(block.need[i]), (0, 0, 0)
        own_seeds = slice(block.first_seed[i], block.first_seed[i] + block.n_seeds[i])
        seeds, places_of = block.kind[own_seeds], block.place[own_seeds]
        left = np.searchsorted(kind, seeds)
        many = np.searchsorted(kind, seeds, side="right") - left
        # an item starts about there; more insertions and deletions than the slack cost too much
        slack = m - need + 1
        begins = np.unique(at[ranges(left, many)] - np.repeat(places_of, many))
        cut = np.flatnonzero(np.diff(begins) > m + 2 * slack) + 1
        lows = np.maximum(begins[np.append(0, cut)] - slack, 0)
        highs = np.minimum(begins[np.append(cut, len(begins)) - 1] + m + slack, len(words))
        # nor can one score more than the words of the text there that the item holds
        vocabulary = block.word[block.begin[i] : block.begin[i] + m]
        own[vocabulary] = True
        places = np.sort(known[own[which]])
        own[vocabulary] = False
        held = np.searchsorted(places, highs) - np.searchsorted(places, lows)
        for lo, hi in zip(*(x[held >= need].tolist() for x in (lows, highs)), strict=True):
            window = words[lo:hi]
            if np.isin(item, window).sum() < need:
                continue
            score, a, z = align(item, window)
            if score > best[0]:
                best = (score, lo + a, lo + z)
        if best[0] >= need:
            yield int(i), best[0] / m, best[1], best[2]


def _finder(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, hasher = block.value, leak_hasher()
        for batch in batches:
            found = [
                (i, *leak)
                for i, view in enumerate(lowered(batch.column(1)))
                if view is not None
                for leak in leaks_in(b, hasher.words(view))
            ]
            if found:
                row, item, score, first, last = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([b.ids[i] for i in item], pa.int64()),
                     pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    ["id", "item_id", "score", "first_word", "last_word"],
                )

    return run


def _cleaner(block, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, hasher = block.value, leak_hasher()
        for batch in batches:
            clean = [
                view is None or next(leaks_in(b, hasher.words(view)), None) is None
                for view in lowered(batch.column(place))
            ]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = LEAST_SCORE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id, item_id, score, first_word, last_word)`` for every document and the test items it leaks.

    Seeds are the rarest pairs of words of an item, as many as make sure that no
    leak is without one (see above); they join texts to items in the scan. Around
    the seeds the item is aligned with the text, match 1, mismatch and gap -1,
    unless the words there cannot reach the least score. A leak scores at least
    ``least`` of the item's words and two at least; an item of one word leaks
    where the word stands. Words are split at blanks and ASCII punctuation, all
    letters lower-cased.

    Items go to the tasks in blocks of a fixed number of words; a benchmark of
    any size is worked off block by block, each over all documents. Nothing is
    shuffled.

    Null and empty texts leak nothing. Items that are null or without words
    match nothing. Rows repeated in either table give
    repeated result rows. A null document id is kept as null. Empty tables give
    an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, item_id long, score double, first_word long, last_word long"
    found = None
    for block in _blocks(benchmark, item_id, item_text, block_words, least):
        sent = spark.sparkContext.broadcast(block)
        leaks = texts.mapInArrow(lean(_finder(sent)), schema)
        found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = LEAST_SCORE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows of ``docs`` that leak no test item, all columns as they were."""
    for block in _blocks(benchmark, item_id, item_text, block_words, least):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(lean(_cleaner(sent, docs.columns.index(text))), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int, least: float) -> Iterator[Block]:
    """All items, a bounded number of words at a time; a longer item stands alone."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = materialize(items.where("text is not null"), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # bytes bound words
    n_blocks = max(1, -(-total // (4 * block_words)))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        if rows:
            yield Block([r["item_id"] for r in rows], [r["text"] for r in rows], least)
    discard(items)
