import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairweave.llm import token_store as ts
from pairweave.llm.queries import public_tokenizer

TEXTS = [
    "a b  c", " lead", "trail ", "", None, " ", "  ", "x\n y", "a \nb", "it's  we'll go", "é è ü 　x", "1 2 345",
    "end <|endoftext|> next<|endoftext|> b", "a\tb c", "line one.\nline two, three", "\x85 z", "word " * 500, "😀 😀  x",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer())


def plain(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_tokens_equal_whole_encoding(tokenizer):
    words = ts.WordTokens(public_tokenizer())
    for _ in range(2):  # the second time from remembered words
        flat, counts = words.encode(pa.array(TEXTS))
        want = plain(tokenizer, TEXTS)
        assert counts.tolist() == [len(x) for x in want]
        assert flat.tolist() == [x for y in want for x in y]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé1 .\n\t  -"), max_size=20), max_size=5))
def test_word_tokens_on_any_text(texts):
    flat, counts = ts._worker_tokens(public_tokenizer()).encode(pa.array(texts, pa.string()))
    want = plain(ts._worker_tokens(public_tokenizer()).tokenizer, texts)
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [x for y in want for x in y]


@pytest.mark.parametrize("bits", [4, 8, 16])
@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
def test_image_gives_random_access(bits, top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top + 1, 1000, dtype=np.uint64).astype(np.uint32)
    counts = np.array([0, 300, 0, 699, 1])
    image = ts.Image(ts.pack_image(np.arange(5), counts, ids, bits))
    assert image.tokens().tolist() == ids.tolist()
    assert [image.token(i) for i in range(0, 1000, 7)] == ids[::7].tolist()
    for a, b in [(0, 0), (5, 64), (63, 65), (64, 128), (900, 1000), (999, 1000), (1000, 1000)]:
        assert image.tokens(a, b).tolist() == ids[a:b].tolist()
    assert image.starts.tolist() == [0, 0, 300, 300, 999, 1000]
    with pytest.raises(IndexError):
        image.token(1000)
    with pytest.raises(ValueError):
        ts.Image(b"something else" * 9)


def test_written_and_read_back(spark, tokenizer, tmp_path):
    rows = [(7 * i % 101, TEXTS[i % len(TEXTS)], i, "clash") for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, id string").repartition(5)
    target = str(tmp_path / "tokens")
    ts.write_tokens(docs, target, public_tokenizer(), image_tokens=64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.read_documents(spark, target).collect()}
    start, every = 0, []
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        ids = plain(tokenizer, [text])[0] + [2]
        assert got.pop(doc_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, every = start + len(ids), every + ids
    assert not got
    assert [ts.read_token(spark, target, i) for i in (0, 500, len(every) - 1)] == [every[i] for i in (0, 500, -1)]
    with pytest.raises(IndexError):
        ts.read_token(spark, target, len(every))


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ts.tokenised(empty, public_tokenizer()).collect() == []
    rows = [(None, "x y"), (3, "z"), (None, None), (None, "a"), (3, "b")]
    got = ts.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizer()).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [
        (None, 0, 2), (None, 2, 1), (None, 3, 3), (3, 6, 2), (3, 8, 2),
    ]


def doubled(a, b, steps):
    """Two unlike words whose polynomial hashes modulo 2**64 agree."""
    word, other = a, b
    for _ in range(steps):
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("letters", [("a", "b"), ("中", "文")])
def test_words_that_a_polynomial_confuses(tokenizer, letters):
    texts = [f"x {w} y" for w in doubled(*letters, 11)]
    flat, counts = ts.WordTokens(public_tokenizer()).encode(pa.array(texts))
    assert flat.tolist() == [x for y in plain(tokenizer, texts) for x in y]


@pytest.mark.parametrize("known", [4, 1 << 21])
def test_words_of_one_hash_keep_their_own_ids(tokenizer, monkeypatch, known):
    monkeypatch.setattr(ts, "KNOWN_WORDS", known)
    words = ts.WordTokens(public_tokenizer())
    spans = words.hasher.spans

    def few(raw):
        h, s, e = spans(raw)
        return h % np.uint64(3), s, e

    monkeypatch.setattr(words.hasher, "spans", few)
    for texts in (TEXTS, TEXTS[::-1], ["one two three four five six one two", "six five two"]):
        flat, counts = words.encode(pa.array(texts))
        assert flat.tolist() == [x for y in plain(tokenizer, texts) for x in y]
        assert counts.tolist() == [len(x) for x in plain(tokenizer, texts)]
