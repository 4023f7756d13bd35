"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its own hash and the mean embedding of its
character n-grams, so inflected or unseen forms are recognised by their letters.
Every text is cut into overlapping windows, all of them are scored, and the
highest window is the text's score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairweave.functions.text import seeded_digest
from pairweave.llm.texts import WordHasher, groups, lean, mixed, text_views

WINDOW, STRIDE = 64, 48  # words; neighbours share 16
BUCKETS = 1 << 14  # rows of either embedding table
WORD_SIZE = CHAR_SIZE = 8
HIDDEN, ATTENTION = 16, 8
GRAMS = (3, 4, 5)  # bytes, with a mark before and after the word
TRAIN_ROWS = 3000  # labelled texts of either class that are learnt from, at most
TRAIN_BYTES = 16_000  # texts longer than this are not learnt from; they are scored like all others
EPOCHS, BATCH, RATE = 5, 48, 4e-3
PARAMETERS = ("words", "chars", "input", "bias", "forward", "backward", "look", "look_bias", "query", "out", "out_bias")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x)
    with np.errstate(over="ignore"):  # an infinite power gives 0
        np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def toxic_hasher() -> WordHasher:
    hasher = WordHasher(fold=True)
    hasher.blank[[i for i in range(128) if not chr(i).isalnum()]] = True
    return hasher


class Words:
    """The distinct words of some texts, their n-grams, and the windows over them."""

    def __init__(self, views: list[np.ndarray | None], hasher: WordHasher):
        found = [hasher.spans(v) if v is not None else None for v in views]
        hashes = [f[0] if f else np.zeros(0, np.uint64) for f in found]
        self.counts = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.kinds, first, self.place = np.unique(flat, return_index=True, return_inverse=True)
        self.bucket = (self.kinds >> np.uint64(50)).astype(np.int64)
        at = np.cumsum([0, *[0 if v is None else len(v) for v in views]])
        spans = [(f[1] + at[i], f[2] + at[i]) for i, f in enumerate(found) if f]
        starts, ends = (np.concatenate([*x, np.zeros(0, np.int64)])[first] for x in (zip(*spans, strict=True) if spans else ((), ())))
        data = np.concatenate([*[v for v in views if v is not None], np.zeros(1, np.uint8)])
        self._grams(hasher.values, data, starts, ends - starts)
        self._windows()

    def _grams(self, values: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Hashed n-grams of each distinct word between two marks, all words at once."""
        sizes = lengths + 2
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[word] - place
        mark = (place == 0) | (left == 1)
        letters = np.where(mark, values[0], values[data[np.where(mark, 0, starts[word] + place - 1)]])
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.uint16))]
        with np.errstate(over="ignore"):
            for n in GRAMS:
                code = np.zeros(max(0, len(word) - n + 1), np.uint64)
                for k in range(n):
                    code = code * np.uint64(0x9E3779B97F4A7C15) + letters[k : k + len(code)]
                at = np.flatnonzero(left[: len(code)] >= n)
                parts.append((word[at], (mixed(code[at]) >> np.uint64(50)).astype(np.uint16)))
        words_of, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(words_of, kind="stable")
        self.gram_word, self.gram = words_of[order], gram[order]

    def _windows(self) -> None:
        """Word indices per window, -1 where a short text has no more words; the last window ends with the text."""
        begins, rows, texts, base = [], [], [], 0
        for i, n in enumerate(self.counts.tolist()):
            if n:
                at = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
                at[-1] = max(0, min(at[-1], n - WINDOW))
                begins.append(base + at)
                rows.append(np.full(len(at), base + n))
                texts.append(np.full(len(at), i))
            base += n
        none = np.zeros(0, np.int64)
        begin, end = np.concatenate([*begins, none]), np.concatenate([*rows, none])
        self.window_text = np.concatenate([*texts, none])
        grid = begin[:, None] + np.arange(WINDOW)[None, :]
        inside = grid < end[:, None]
        self.index = np.full(grid.shape, -1, np.int32)
        self.index[inside] = self.place[grid[inside]]


def first_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = WORD_SIZE + CHAR_SIZE

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    return {
        "words": normal(BUCKETS, WORD_SIZE, scale=0.1),
        "chars": normal(BUCKETS, CHAR_SIZE, scale=0.3),
        "input": normal(wide, 6 * HIDDEN, scale=wide**-0.5),
        "bias": np.zeros(6 * HIDDEN, np.float32),
        "forward": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "backward": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "look": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5),
        "look_bias": np.zeros(ATTENTION, np.float32),
        "query": normal(ATTENTION, scale=ATTENTION**-0.5),
        "out": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
        "out_bias": np.full(1, -1, np.float32),
    }


def embed(w: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Word embedding beside the mean n-gram embedding, one row per distinct word."""
    out = np.zeros((len(words.kinds), WORD_SIZE + CHAR_SIZE), np.float32)
    if len(out):
        out[:, :WORD_SIZE] = w["words"][words.bucket]
        starts = np.searchsorted(words.gram_word, np.arange(len(out)))
        sums = np.add.reduceat(w["chars"][words.gram], starts, axis=0)
        out[:, WORD_SIZE:] = sums / np.diff(np.append(starts, len(words.gram)))[:, None]
    return out


def _pass(gates: np.ndarray, index: np.ndarray, recurrent: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    """Hidden states of one direction, (step, window, unit); ``keep`` collects what its gradient needs.

    The update and reset gates and the candidate are separate, so that every
    array is contiguous and is worked on in place.
    """
    n, steps = index.shape
    wide = 2 * HIDDEN
    first, second = np.ascontiguousarray(gates[:, :wide]), np.ascontiguousarray(gates[:, wide:])
    one, two = np.ascontiguousarray(recurrent[:, :wide]), np.ascontiguousarray(recurrent[:, wide:])
    h, out = np.zeros((n, HIDDEN), gates.dtype), np.zeros((steps, n, HIDDEN), gates.dtype)
    rows, ragged = np.ascontiguousarray(index.T), (index < 0).any()
    for t in range(steps - 1, -1, -1) if back else range(steps):
        zr = first.take(rows[t], axis=0, mode="wrap")  # -1 is the last row, which stands for no word
        zr += h @ one
        zr = _sigmoid(zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        u = h @ two
        c = second.take(rows[t], axis=0, mode="wrap")
        c += r * u
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(c, h, out=new)
        new *= z
        new += h
        if ragged:
            np.copyto(new, h, where=(rows[t] < 0)[:, None])
        if keep is not None:
            keep.append((t, h, z, r, c, u))
        h = new
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    gates = np.concatenate([x @ w["input"] + w["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
    sides = [None if keep is None else [], None if keep is None else []]
    one = _pass(gates[:, : 3 * HIDDEN], index, w["forward"], False, sides[0])
    two = _pass(gates[:, 3 * HIDDEN :], index, w["backward"], True, sides[1])
    h = np.concatenate([one, two], axis=2)
    looked = h @ w["look"]
    looked += w["look_bias"]
    np.tanh(looked, out=looked)
    score = np.where(index.T >= 0, looked @ w["query"], np.float32(-1e9))
    share = np.exp(score - score.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", share, h)
    if keep is not None:
        keep.update(sides=sides, h=h, looked=looked, share=share, pooled=pooled)
    return pooled @ w["out"] + w["out_bias"]


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        kinds, first = np.unique(rows[order], return_index=True)
        out[kinds] = np.add.reduceat(values[order], first, axis=0)
    return out


def gradients(w: dict[str, np.ndarray], words: Words, index: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Back-propagation of ``slope``, the loss's derivative at each window's logit."""
    x, keep = embed(w, words), {}
    forward(w, x, index, keep)
    h, looked, share, pooled = keep["h"], keep["looked"], keep["share"], keep["pooled"]
    g = {"out": slope @ pooled, "out_bias": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * w["out"]
    d_h = share[:, :, None] * d_pooled
    d_share = np.einsum("nk,tnk->tn", d_pooled, h)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    g["query"] = np.einsum("tn,tna->a", d_score, looked)
    d_look = d_score[:, :, None] * w["query"] * (1 - looked**2)
    g["look"], g["look_bias"] = np.einsum("tnk,tna->ka", h, d_look), d_look.sum(axis=(0, 1))
    d_h = d_h + d_look @ w["look"].T
    n, steps = index.shape
    d_gates = np.zeros((steps, n, 6 * HIDDEN), np.float32)
    for side, name in enumerate(("forward", "backward")):
        a, d, total = side * HIDDEN, np.zeros((n, HIDDEN), np.float32), np.zeros_like(w[name])
        for t, before, z, r, c, u in reversed(keep["sides"][side]):
            real = (index[:, t] >= 0)[:, None]
            d = d + d_h[t, :, a : a + HIDDEN]
            d_z, d_c = d * (c - before) * z * (1 - z), d * z * (1 - c**2)
            d_r = d_c * u * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], axis=1) * real
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1) * real
            d_gates[t, :, 3 * a : 3 * a + 3 * HIDDEN] = d_x
            total += before.T @ d_u
            d = np.where(real, d * (1 - z), d) + d_u @ w[name].T
        g[name] = total
    flat = index.T.ravel()
    d_words = _scatter(flat[flat >= 0], d_gates.reshape(-1, 6 * HIDDEN)[flat >= 0], len(x))
    g["input"], g["bias"] = x.T @ d_words, d_words.sum(axis=0)
    d_x = d_words @ w["input"].T
    g["words"] = _scatter(words.bucket, d_x[:, :WORD_SIZE], BUCKETS)
    per_gram = np.bincount(words.gram_word, minlength=len(x)).astype(np.float32)
    g["chars"] = _scatter(words.gram, (d_x[:, WORD_SIZE:] / np.maximum(per_gram, 1)[:, None])[words.gram_word], BUCKETS)
    return g


def train(texts: list[str], labels: np.ndarray, seed: int = 6, epochs: int | None = None) -> dict[str, np.ndarray]:
    """Adam on the highest window of each text: a toxic text needs one toxic window, a clean one has none."""
    w, rng, hasher = first_weights(seed), np.random.default_rng(seed), toxic_hasher()
    views = list(text_views(pa.array(texts, pa.string())))
    batches, step, epochs = [], 0, epochs or EPOCHS
    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        batches.append((Words([views[i] for i in rows], hasher), labels[rows]))
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            words, marks = batches[b]
            if not len(words.index):
                continue
            logits = forward(w, embed(w, words), words.index)
            best = np.lexsort((logits, words.window_text))
            best = best[np.append(np.flatnonzero(np.diff(words.window_text[best])), len(best) - 1)]
            slope = (_sigmoid(logits[best]) - marks[words.window_text[best]]).astype(np.float32) / len(best)
            step += 1
            for k, d in gradients(w, words, words.index[best], slope).items():
                mean[k] += 0.1 * (d - mean[k])
                square[k] += 0.01 * (d * d - square[k])
                w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return w


def pack(w: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in PARAMETERS}


def score_views(w: dict[str, np.ndarray], views: list[np.ndarray | None], hasher: WordHasher) -> np.ndarray:
    """Highest window of each text as a probability; 0 for a text without words."""
    words = Words(views, hasher)
    out = np.zeros(len(views))
    if len(words.index):
        logits = forward(w, embed(w, words), words.index).astype(np.float64)
        np.maximum.at(out, words.window_text, _sigmoid(logits))
    return out


SCORE = "__toxicity"  # the added column, a name no table has
PIECE = 1 << 18  # bytes of text scored at once


def pieces(view: np.ndarray, hasher: WordHasher) -> Iterator[np.ndarray]:
    """A long text in parts that overlap by a window, so that every run of words lies whole in one."""
    if len(view) <= PIECE:
        yield view
        return
    _, starts, ends = hasher.spans(view)
    first = 0
    while first < len(starts):
        last = max(first + 2 * WINDOW, int(np.searchsorted(ends, starts[first] + PIECE)))
        last = min(last, len(starts))
        yield view[starts[first] : ends[last - 1]]
        if last == len(starts):
            return
        first = last - WINDOW


def _scores(w: dict[str, np.ndarray], column: pa.Array, hasher: WordHasher) -> np.ndarray:
    scores = [np.zeros(0)]
    for a, b in groups(column, PIECE):
        views = list(text_views(column.slice(a, b - a)))
        if b - a == 1 and views[0] is not None:
            scores.append([max((score_views(w, [p], hasher)[0] for p in pieces(views[0], hasher)), default=0.0)])
        else:
            scores.append(score_views(w, views, hasher))
    return np.concatenate(scores)


def _scorer(sent, place: int):
    """Adds the score of the text at column ``place`` as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = unpack(sent.value), toxic_hasher()
        for batch in batches:
            score = pa.array(_scores(w, batch.column(place), hasher), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, SCORE])

    return run


def _trainer(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["place"], r["text"]))
        if not rows:
            return
        w = train([r["text"] for r in rows], np.array([r["label"] for r in rows], np.float32), seed)
        yield pa.RecordBatch.from_arrays([pa.array([pack(w)], pa.binary())], ["model"])

    return run


def held_out(id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES, seed: int = 6) -> bytes | None:
    """Weights learnt from a bounded sample of labelled texts that are not held out.

    The sample is, of either class, the ``rows`` texts of at most ``longest``
    bytes that come first in a seeded order of ids. It goes to one task, whose
    result is the packed weights; None if there is nothing to learn from.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id))
    marks = marks.groupBy(F.col(id).cast("long").alias("id")).agg(F.max(label).alias("label"))
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    usable = texts.where(F.octet_length("text").between(1, longest)).select("id").join(marks, "id").distinct()
    placed = usable.withColumn("place", seeded_digest("id", seed))
    chosen = [placed.where(f"label = {k}").orderBy("place").limit(rows) for k in (0, 1)]
    sample = texts.where(F.octet_length("text").between(1, longest)).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "id"
    )  # at most 2 * rows ids
    sample = sample.select("place", "label", "text").repartition(1)  # only the sample is moved to one task
    found = sample.mapInArrow(lean(_trainer(seed)), "model binary").first()
    return bytes(found[0]) if found else None


def with_toxicity(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the score of each row as a last column named by ``SCORE``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(SCORE, DoubleType())])
    return docs.mapInArrow(lean(_scorer(sent, docs.columns.index(text))), schema)


def toxicity(docs: DataFrame, model: bytes | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, score, predicted)`` for every document: its highest window, toxic from 0.5 on.

    All overlapping windows of the whole text are scored; a very long text is
    worked off in parts that overlap by a window. Nothing is shuffled. Null,
    empty and wordless texts score 0. Null ids are kept, repeated rows repeat,
    extra columns are not read, an empty table gives an empty result. Without a
    model every text scores 0.
    """
    if model is None:
        return docs.select(id, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = with_toxicity(docs.select(F.col(id).alias(id), F.col(text).alias("text")), model)
    return scored.select(id, F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below 0.5, all columns as they were."""
    return with_toxicity(docs, model, text).where(F.col(SCORE) < 0.5).drop(SCORE)
