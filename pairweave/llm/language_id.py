"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal) under an elastic net, then
calibrated by one temperature on rows that training did not see.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.text import seeded_digest
from pairweave.llm.texts import lean

BUCKETS = 1 << 14  # hashed n-grams of one to three characters
ORDERS = 3
TRAIN_ROWS = 2000  # rows of each language that the classifier is fitted on, at most
PARTS = 64  # a language is ranked in so many parts before it is ranked whole
CALIBRATE = 5  # one row in so many of them sets the temperature instead
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-4
UNKNOWN = "und"
PIECE = 1 << 20  # characters of a text worked on at once


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything that is no letter becomes one break."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = points >= 0xAA
    letter |= (points >= 97) & (points <= 122)
    return np.where(letter, points, np.uint32(0))


def counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram in the whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), PIECE):
        # a piece begins with the last characters of the one before, which count once
        back = min(at, ORDERS - 1)
        codes = _codes(text[at - back : at + PIECE])
        gram = np.zeros(len(codes), np.uint32)
        for order in range(1, ORDERS + 1):
            gram = gram[: len(codes) - order + 1] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(order)
            mixed = gram * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed = mixed * np.uint32(0x85EBCA77) >> np.uint32(18)
            used = codes[: len(gram)] != 0
            used |= codes[order - 1 :] != 0  # runs of breaks say nothing
            used[: max(0, back - order + 1)] = False
            total += np.bincount(mixed[used], minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF at unit length."""
    x = count * idf
    size = np.sqrt(x @ x)
    return x / size if size else x


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; weights are zero until their gradients outweigh the l1 term."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor on the logits under which the labels are likeliest; golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits * np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -2.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, seed: int = 2) -> dict[str, np.ndarray]:
    """``rows`` hold the n-grams that occur, their counts, and the language."""
    names = sorted({lang for _, _, lang in rows})
    known = []
    for at, count, lang in rows:
        x = count * idf[at]
        x = x / max(np.sqrt(x @ x), 1e-12)
        known.append((np.append(at, BUCKETS), np.append(x, 1.0), names.index(lang)))  # the last is the bias
    held = [k for i, k in enumerate(known) if i % CALIBRATE == CALIBRATE - 1]
    fitted = [k for i, k in enumerate(known) if i % CALIBRATE != CALIBRATE - 1]
    model, rng = Ftrl(len(names)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            model.learn(*fitted[i])
    w = model.weights(slice(None))
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(names))
    factor = temperature(logits, np.array([label for *_, label in held], np.int64))
    return {"names": np.array(names, "U"), "weights": w * factor, "idf": idf}


def pack(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in ("names", "weights", "idf")}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in which each n-gram occurs, and their number, for a task's rows."""
    total, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                total += counts(text.as_py()) > 0
                docs += 1
    gram = np.append(np.flatnonzero(total), -1)
    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.append(total[total > 0], docs))], ["gram", "docs"])


def _trainer(idf: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for place, lang, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                count = counts(text.as_py())
                at = np.flatnonzero(count)
                rows.append((place.as_py(), at, count[at], lang.as_py()))
        if rows:
            rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
            model = train([r[1:] for r in rows], idf, seed)
            yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], ["model"])

    return run


def _predictor(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpack(sent.value)
        names, w, idf = model["names"], model["weights"], model["idf"].astype(np.float32)
        front, bias = np.ascontiguousarray(w[:BUCKETS]).astype(np.float32), w[BUCKETS]
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(1):
                text = value.as_py()
                if not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                share = softmax(features(counts(text).astype(np.float32), idf) @ front + bias)
                best = int(share.argmax())
                langs.append(str(names[best]))
                scores.append(float(share[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, learnable, id: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = TRAIN_ROWS, seed: int = 2) -> bytes | None:
    """Packed model from the documents for which the condition ``learnable`` holds; None if there are none.

    Inverse document frequencies are counted over all of them. The classifier is
    fitted on at most ``rows`` texts of each language, the first in a seeded order
    of ids, in one task that holds n-gram counts, not texts; a repeated row of one
    id, language and text is learnt from once.
    """
    usable = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(F.col(id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = usable.select("text").mapInArrow(lean(_frequencies), "gram long, docs long")
    frequency, n_docs = np.zeros(BUCKETS), 0
    for r in found.groupBy("gram").agg(F.sum("docs").alias("docs")).collect():  # a row per n-gram bucket
        if r["gram"] < 0:
            n_docs = r["docs"]
        else:
            frequency[r["gram"]] = r["docs"]
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    place = seeded_digest(F.coalesce("id", F.lit("")), seed)
    named = usable.select(place.alias("place"), "lang", F.xxhash64("text").alias("digest"), "text")
    placed = named.select("place", "lang", "digest").distinct()
    # ranked in parts first, so that a frequent language is not one task's
    part = F.pmod(F.crc32(F.col("place").cast("binary")), F.lit(PARTS))
    chosen = placed.withColumn("row", F.row_number().over(W.partitionBy("lang", part).orderBy("place", "digest"))).where(F.col("row") <= rows)
    chosen = chosen.withColumn("row", F.row_number().over(W.partitionBy("lang").orderBy("place", "digest"))).where(F.col("row") <= rows)
    # bounded by rows times languages, so it is broadcast; only the sample itself is moved, each text once
    sample = named.join(F.broadcast(chosen.drop("row")), ["place", "lang", "digest"]).drop("digest").dropDuplicates()
    sample = sample.select("place", "lang", "text").repartition(1)
    model = sample.mapInArrow(lean(_trainer(idf, seed)), "model binary").first()
    return bytes(model[0]) if model else None


def identify(docs: DataFrame, model: bytes | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every document, from its whole text alone.

    ``score`` is the calibrated probability of the predicted language. Null texts
    and texts without a letter are ``und`` with score 0, and so is every text
    without a model. Null ids and repeated rows are kept; extra columns are not
    read; an empty table gives an empty result. Nothing is shuffled.
    """
    if model is None:
        return docs.select(id, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(lean(_predictor(sent)), f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id)
