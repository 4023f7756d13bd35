"""Token ids in directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of ``BITS`` bits, lowest first. Level 0 holds the first
chunk of every id; a continuation bitmap marks the ids that go on, and the next
level holds the second chunk of those only. A rank directory counts the marks
before every 64-bit word, so the place of a token in the next level is one
directory entry and one popcount away.

A file image is: magic, counts, one section per level (chunks, bitmap words,
rank directory), then the document index (ids, starts). Images are stored as
binary rows of a Parquet dataset, which commits them atomically and works on
any file system; a row's other columns say what it holds.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.llm.texts import PlacedHasher, groups, lean, text_views
from pairweave.session import own, work_path

BITS = 8
MAGIC = b"DACTOK02"
END_ID = 2
IMAGE_TOKENS = 1 << 20  # an image is closed once it holds this many ids; one document is never cut
COMPARED = 1 << 14  # words whose bytes are compared at a time
KNOWN_WORDS = 1 << 21  # distinct words a Python worker remembers between batches


# --- the code itself -------------------------------------------------------------------------


def encode_levels(ids: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of ``(chunks, continuation words, ranks before each word)``."""
    kind = np.uint8 if bits <= 8 else np.uint16
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunks = (rest & np.uint64((1 << bits) - 1)).astype(kind)
        more = (rest >> np.uint64(bits)) > 0
        padded = np.zeros((len(more) + 63) // 64 * 64, bool)
        padded[: len(more)] = more
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)[:-1]]).astype(np.uint32)
        levels.append((chunks, words, ranks[: len(words)]))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(bits)


def pack_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int = BITS, nameless: int = 0) -> bytes:
    """The first ``nameless`` documents have no id."""
    levels = encode_levels(ids, bits)
    out = [MAGIC, struct.pack("<IIQQQ", bits, len(levels), len(doc_ids), nameless, len(ids))]
    for chunks, words, ranks in levels:
        out += [struct.pack("<QQ", len(chunks), len(words)), chunks.tobytes(), b"\0" * (-chunks.nbytes % 8)]
        out += [words.tobytes(), ranks.tobytes(), b"\0" * (-ranks.nbytes % 8)]
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([*out, doc_ids.astype("<i8").tobytes(), starts.tobytes()])


class Image:
    """A read image; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token image")
        self.bits, n_levels, n_docs, self.nameless, self.n_tokens = struct.unpack_from("<IIQQQ", data, 8)
        kind = np.dtype(np.uint8 if self.bits <= 8 else "<u2")
        at, self.levels = 40, []
        for _ in range(n_levels):
            n, n_words = struct.unpack_from("<QQ", data, at)
            at += 16
            chunks = np.frombuffer(data, kind, n, at)
            at += chunks.nbytes + -chunks.nbytes % 8
            words = np.frombuffer(data, "<u8", n_words, at)
            at += words.nbytes
            ranks = np.frombuffer(data, "<u4", n_words, at)
            at += ranks.nbytes + -ranks.nbytes % 8
            self.levels.append((chunks, words, ranks))
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * n_docs).astype(np.int64)

    def token(self, i: int) -> int:
        """Id at position ``i``: one chunk per level, nothing else is decoded."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (level * self.bits)
            word, bit = int(words[i >> 6]), i & 63
            if not word >> bit & 1:
                break
            i = int(ranks[i >> 6]) + (word & ((1 << bit) - 1)).bit_count()
        return value

    def tokens(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of a range, level by level."""
        start, end = int(start), int(self.n_tokens if end is None else end)
        out = np.zeros(end - start, np.uint32)
        where, lo, hi = np.arange(end - start), start, end
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(level * self.bits)
            if lo >= hi:
                break
            first = lo >> 6
            marks = np.unpackbits(words[first : (hi + 63) >> 6].view(np.uint8), bitorder="little")
            marks = marks[lo - 64 * first : hi - 64 * first].astype(bool)
            word, bit = int(words[first]), lo & 63
            lo = int(ranks[first]) + (word & ((1 << bit) - 1)).bit_count()
            where = where[marks]
            hi = lo + len(where)
            if lo == hi:
                break
        return out


# --- tokenising ------------------------------------------------------------------------------


class WordTokens:
    """Ids of whole texts, made from the ids of their distinct words.

    A byte-level pre-tokeniser never joins two sides of a single blank between
    two non-blanks, so a text cut before such blanks gives the ids of its pieces
    in a row. A text with two white-space characters in a row is encoded whole.
    Words met before are found through a table addressed by their hash and count
    only when all their bytes agree, so words of one hash keep ids of their own.
    """

    BLANKS = r"\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # may begin a wide blank
    TAB = "\t"
    JOINED = 100  # new words encoded in one call, with a tab between them

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs = re.compile(f"[{self.BLANKS}]{{2}}")
        self.narrow = np.zeros(256, bool)
        self.narrow[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.hasher = PlacedHasher()
        self.hasher.blank[:] = False
        self.hasher.blank[32] = True
        self.feed = self._encode([self.TAB])[0]
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(2 * KNOWN_WORDS, -1, np.int32)
        self.n = self.n_ids = self.n_bytes = 0
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.at, self.byte_at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.size, self.length = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids, self.bytes = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint8)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        grown = np.zeros(max(n, len(array) * 3 // 2), array.dtype)
        grown[: len(array)] = array
        return grown

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the words, their ids in a row in that order, and the number of ids of each.

        Words that take the blank before them and hold no tab are encoded many at
        a time, a tab between them; where its id does not come back once per
        border, the words of that call are encoded one by one.
        """
        many = [i for i, w in enumerate(words) if w[:1] == b" " and b"\t" not in w] if len(self.feed) == 1 else []
        calls = [many[i : i + self.JOINED] for i in range(0, len(many), self.JOINED)]
        order, flats, sizes = [], [], []
        for call, ids in zip(calls, self._encode([b"\t".join([words[i] for i in c]).decode() for c in calls]), strict=True):
            flat = np.array(ids, np.uint32)
            border = flat == self.feed[0]
            cut = np.flatnonzero(border)
            if len(cut) == len(call) - 1:
                order += call
                flats.append(flat[~border])
                sizes.append(np.diff(cut, prepend=-1, append=len(flat)) - 1)
        joined = np.zeros(len(words), bool)
        joined[order] = True
        alone = np.flatnonzero(~joined).tolist()
        for ids in self._encode([words[i].decode() for i in alone]):
            flats.append(np.array(ids, np.uint32))
            sizes.append(np.array([len(ids)]))
        return order + alone, np.concatenate([*flats, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Keep words and their ids; their numbers."""
        order, flat, sizes = self._encode_words(words)
        words, hashes = [words[i] for i in order], hashes[order]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        new, n, n_ids, n_bytes = len(words), self.n, self.n_ids, self.n_bytes
        for name, end in (("hashes", n + new), ("at", n + new), ("byte_at", n + new), ("size", n + new), ("length", n + new),
                          ("ids", n_ids + len(flat)), ("bytes", n_bytes + int(lengths.sum()))):
            setattr(self, name, self._room(getattr(self, name), end))
        self.hashes[n : n + new], self.size[n : n + new], self.length[n : n + new] = hashes, sizes, lengths
        self.at[n : n + new] = n_ids + np.cumsum(sizes) - sizes
        self.byte_at[n : n + new] = n_bytes + np.cumsum(lengths) - lengths
        self.ids[n_ids : n_ids + len(flat)] = flat
        self.bytes[n_bytes : n_bytes + int(lengths.sum())] = np.frombuffer(b"".join(words), np.uint8)
        self.n, self.n_ids, self.n_bytes = n + new, n_ids + len(flat), n_bytes + int(lengths.sum())
        numbers = np.empty(new, np.int64)
        numbers[order] = np.arange(n, n + new)
        return numbers

    def _file(self, numbers: np.ndarray) -> None:
        """Give each word the next free slot after the one its hash names."""
        mask = len(self.slots) - 1
        at = (self.hashes[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several words for one slot one stays
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & mask

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words of these hashes, -1 where there is none."""
        mask = len(self.slots) - 1
        out = np.full(len(hashes), -1, np.int64)
        rows, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(rows):
            number = self.slots[at].astype(np.int64)
            here = (number >= 0) & (self.hashes[number] == hashes[rows])
            out[rows[here]] = number[here]
            on = (number >= 0) & ~here
            rows, at = rows[on], (at[on] + 1) & mask
        return out

    def _unlike(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Rows whose bytes are not those of the word they were given."""
        wrong = sizes != self.length[numbers]
        right = np.flatnonzero(~wrong)
        for a in range(0, len(right), COMPARED):  # sizes the work arrays
            rows = right[a : a + COMPARED]
            size = sizes[rows]
            firsts = np.cumsum(size) - size
            step = np.arange(int(size.sum()))
            theirs = self.bytes[step + np.repeat(self.byte_at[numbers[rows]] - firsts, size)]
            same = raw[step + np.repeat(starts[rows] - firsts, size)] == theirs
            if not same.all():
                wrong[rows[np.unique(np.searchsorted(firsts, np.flatnonzero(~same), "right") - 1)]] = True
        return np.flatnonzero(wrong)

    def _numbers(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word of a batch; words not met before are learnt."""
        whole = raw.tobytes()

        def words_at(rows: np.ndarray) -> list[bytes]:
            return [whole[a:b] for a, b in zip(starts[rows].tolist(), (starts[rows] + sizes[rows]).tolist(), strict=True)]

        numbers = self._find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            kinds, firsts, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            learnt = self._learn(kinds, words_at(missing[firsts]))
            self._file(learnt)
            numbers[missing] = learnt[back]
        odd = self._unlike(raw, starts, sizes, numbers)
        if len(odd):  # another word of the same hash: kept beside it, found again by its bytes
            words = words_at(odd)
            kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
            learnt = self._learn(np.zeros(len(kinds), np.uint64), list(kinds))
            numbers[odd] = learnt[[kinds[w] for w in words]]
        return numbers

    def _with_runs(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts in which two white-space characters stand in a row."""
        blank = self.narrow[raw]
        blank[ends] = False  # what stands between two texts
        pairs = np.flatnonzero(blank[1:] & blank[:-1])
        found = np.zeros(len(begins), bool)
        found[np.searchsorted(begins, pairs, "right") - 1] = True
        whole = raw.tobytes()
        if any(w in whole for w in self.WIDE):
            for i in np.flatnonzero(~found).tolist():
                text = whole[begins[i] : ends[i]]
                found[i] = any(w in text for w in self.WIDE) and self.runs.search(text.decode()) is not None
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and their number per text; null counts as empty."""
        none = np.zeros(0, np.uint8)
        views = [none if v is None else v for v in text_views(texts)]
        blank = np.full(1, 32, np.uint8)
        raw = np.concatenate([x for v in views for x in (v, blank)] or [none])
        lengths = np.fromiter(map(len, views), np.int64, len(views))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        runs = self._with_runs(raw, begins, ends)
        whole = {i: views[i].tobytes().decode() for i in np.flatnonzero(runs).tolist()}
        hashes, starts, stops = self.hasher.spans(raw)
        of = np.searchsorted(begins, starts, "right") - 1
        led = starts > begins[of]  # a piece that takes the blank before it
        hashes, starts = (hashes << np.uint64(1)) | led.astype(np.uint64), starts - led
        # a blank that ends a text is a piece of its own
        last = np.flatnonzero((lengths > 0) & (raw[np.maximum(ends - 1, 0)] == 32)) if len(raw) else np.zeros(0, np.int64)
        of, starts, stops = np.append(of, last), np.append(starts, ends[last] - 1), np.append(stops, ends[last])
        hashes = np.append(hashes, np.ones(len(last), np.uint64))
        order = np.argsort(starts, kind="stable") if len(last) else np.arange(len(of))
        order = order[~runs[of[order]]] if len(whole) else order
        hashes, starts, sizes = hashes[order], starts[order], (stops - starts)[order]
        per_text = np.bincount(of[order], minlength=len(views))
        if self.n + len(hashes) > KNOWN_WORDS and self.n + len(np.unique(hashes)) > KNOWN_WORDS:
            self._forget()
        while len(self.slots) < 2 * len(hashes):  # one text of very many words
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
            self._file(np.arange(self.n))
        numbers = self._numbers(raw, hashes, starts, sizes)
        size, at = self.size[numbers].astype(np.int64), self.at[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(at - (ends - size), size)]
        borders = np.concatenate([[0], np.cumsum(per_text)])
        token_at = np.concatenate([[0], ends])[borders]
        counts = np.diff(token_at)
        if whole:
            parts, rows = [], sorted(whole)
            last = 0
            for i, ids in zip(rows, self._encode([whole[i] for i in rows]), strict=True):
                parts += [flat[last : token_at[i]], np.array(ids, np.uint32)]
                last, counts[i] = token_at[i], len(ids)
            flat = np.concatenate([*parts, flat[last:]])
        return flat, counts


def _worker_tokens(path: str) -> WordTokens:
    """One per Python worker and file: words learned in a task serve the next one."""
    shelf = sys.modules.setdefault("_pairweave_token_words", types.ModuleType("_pairweave_token_words"))
    if path not in vars(shelf):
        setattr(shelf, path, WordTokens(path))
    return getattr(shelf, path)


# --- Spark -----------------------------------------------------------------------------------


def _writer(path: str, end_id: int, image_tokens: int):
    schema = pa.schema(
        [("first_doc", pa.int64()), ("last_doc", pa.int64()), ("part", pa.int64()), ("skip", pa.int64()),
         ("n_tokens", pa.int64()), ("image", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, skip, held, n = _worker_tokens(path), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            docs, named, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            image = pack_image(docs, counts, ids, nameless=int((~named).sum()))
            values = [docs[0] if named[0] else None, docs[-1] if named[-1] else None, part, skip, len(ids), image]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy()
            for a, b in groups(batch.column(1), 1 << 20):
                flat, counts = tokens.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype(np.uint32)
                counts = counts + 1
                first = done = 0
                for k, end in enumerate(np.cumsum(counts).tolist()):
                    n += int(counts[k])
                    if n >= image_tokens or k == len(counts) - 1:
                        rows = slice(a + first, a + k + 1)
                        held.append((docs[rows], named[rows], counts[first : k + 1], ids[done:end]))
                        first, done = k + 1, end
                    if n >= image_tokens:
                        yield close()
                        held, skip, n, part = [], skip + n, 0, part + 1
        if held:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    target: str,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    image_tokens: int = IMAGE_TOKENS,
) -> None:
    """Encode whole texts into images below ``target``, documents in ascending id order.

    ``tokenizer`` is the path of a byte-level tokenizer file, the same on every
    executor. One range shuffle sorts the documents. Null text counts as empty;
    a document always ends with ``end_id``. Documents without an id come first,
    and rows under one id, or none, are ordered by a hash of their text. Extra columns are not read; an empty table gives no image.
    """
    ordered = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # equal ids, or none, are cut by their text, so they spread over as many tasks as their texts do
    ordered = ordered.withColumn("cut", F.xxhash64("text")).repartitionByRange("id", "cut").sortWithinPartitions("id", "cut", "text").drop("cut")
    schema = "first_doc long, last_doc long, part long, skip long, n_tokens long, image binary"
    placed = ordered.mapInArrow(lean(_writer(tokenizer, end_id, image_tokens)), schema)
    ranged = placed.withColumn("range", F.spark_partition_id())
    # one image per row group, so that a reader that wants one skips the others by their statistics
    ranged.write.option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(target)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, data = batch.column(0).to_pylist(), batch.column(1)
        for k, start in enumerate(starts):
            image = Image(data[k].as_py())
            crcs = [zlib.crc32(image.tokens(a, b).astype("<u4").tobytes()) for a, b in zip(image.starts, image.starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(image.doc_ids, mask=np.arange(len(image.doc_ids)) < image.nameless), pa.array(start + image.starts[:-1]), pa.array(np.diff(image.starts)), pa.array(crcs, pa.int64())],
                ["id", "start", "n_tokens", "ids_crc32"],
            )


def read_images(spark: SparkSession, source: str) -> DataFrame:
    """Images with ``start``, the number of ids in all images before.

    An image knows its place inside its range; the sums per range are one row
    per written partition, which is what is broadcast.
    """
    images = spark.read.parquet(source)
    ranges = images.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return images.join(F.broadcast(ranges), "range").withColumn("start", F.col("base") + F.col("skip")).drop("base")


def read_documents(spark: SparkSession, source: str, id: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``start``, ``n_tokens`` and the crc32 of its ids as unsigned 32-bit integers."""
    rows = read_images(spark, source).select("start", "image")
    rows = rows.mapInArrow(lean(_reader), "id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("id", id)


def read_token(spark: SparkSession, source: str, position: int) -> int:
    """The id at a global position; one image is fetched and one chunk per level read from it."""
    images = read_images(spark, source)
    row = images.where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).first()
    if row is None:
        raise IndexError(position)
    return Image(bytes(row["image"])).token(position - row["start"])


def tokenised(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to the shared folder, then read every document back from the files."""
    spark = docs.sparkSession
    target = own(spark, work_path(spark, "tokens"))
    write_tokens(docs, target, tokenizer, id, text, end_id)
    return read_documents(spark, target, id)
