"""Operators 7 and 10 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from legajo.llm import bpe, token_count

TEXTS = ["", " ", "a", "Hello  world\n\n it's 12345 naïve — 東京 😀\t!!", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endof", "aaaa" * 700, "ab" * 3000 + " cd" * 3000, "   z\r\n\x00\x7f", "'s 'S don't DON'T"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def random_texts(n):
    r = random.Random(5)
    letters = "abcdeéß ñ .,'\n\t12東😀<|>"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for _ in range(n)]


def test_segment_tree_gives_the_library_ids(library):
    texts = TEXTS + random_texts(200)
    own = bpe.SegmentTreeBpe(bpe.vocabulary_path())
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_decode_of_broken_utf8(library):
    own = bpe.SegmentTreeBpe(bpe.vocabulary_path())
    ids = library.encode("東京 😀", add_special_tokens=False).ids[:-1]
    assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (1000, 100)])
def test_spliced_counts_equal_whole_counts(library, chunk, overlap):
    r = random.Random(3)
    words = ["the", "naïve", "Straße", "12,5", "東京", "😀", "<|endoftext|>", "it's", "\n\n", "a" * 90]
    long = " ".join(r.choice(words) for _ in range(900))
    for text in [*TEXTS, *random_texts(60), long, "x" * 3000, "\n" * 3000]:
        assert token_count.count_long(library, text, token_count.Boundaries(bpe.vocabulary_path()), chunk, overlap) == len(library.encode(text, add_special_tokens=False).ids)


class Watched:
    def __init__(self, library):
        self.library, self.sizes = library, []

    def encode(self, text, **options):
        self.sizes.append(len(text))
        return self.library.encode(text, **options)


@pytest.mark.parametrize("kind", ["cyrillic", "chinese", "accents", "digits", "latin"])
def test_huge_texts_are_encoded_in_bounded_chunks(library, kind):
    r = random.Random(6)
    word = {
        "cyrillic": lambda: "".join(r.choice("абвгдежзийклмн") for _ in range(r.randrange(1, 12))) + " ",
        "chinese": lambda: "".join(r.choice("東京中国人大学生日本語") for _ in range(r.randrange(3, 40))) + r.choice("，。"),
        "accents": lambda: r.choice(["é'é", "it's", "l’été", "'t", "e\u0301", "ñ12", " \n\n "]),
        "digits": lambda: str(r.randrange(10**6)) + r.choice([".", " ", "'"]),
        "latin": lambda: r.choice(["word", "Other", "<|endoftext|>"]) + " ",
    }[kind]
    text = ""
    while len(text) < 400_000:
        text += "".join(word() for _ in range(1000))
    watched = Watched(library)
    got = token_count.count_long(watched, text, token_count.Boundaries(bpe.vocabulary_path()), 1 << 14, 256)
    assert got == len(library.encode(text, add_special_tokens=False).ids)
    assert max(watched.sizes) <= 1 << 14 and sum(watched.sizes) < 1.3 * len(text)


def test_a_stretch_without_boundary_is_one_chunk(library):
    text = "some words here " * 3000 + "x" * 100_000 + " and some more" * 3000
    watched = Watched(library)
    got = token_count.count_long(watched, text, token_count.Boundaries(bpe.vocabulary_path()), 1 << 12, 256)
    assert got == len(library.encode(text, add_special_tokens=False).ids)
    assert max(watched.sizes) < 300_000 and sum(watched.sizes) < 5 * len(text)


def test_long_words_equal_the_library(library):
    r = random.Random(9)
    own = bpe.SegmentTreeBpe(bpe.vocabulary_path())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = ["".join(r.choice(letters) for _ in range(n)) for n in (513, 1024, 1025, 60_000)] + ["a" * 5000, "ab" * 700, "東京中国" * 400, "=-" * 1000]
    for w, ids in zip(words, own.encode_batch(words), strict=True):
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids
    assert not any(len(w) > bpe.LONG for w in own.cache)


def test_queries_on_odd_rows(spark, library):
    rows = [(1, None, "en", 5), (2, "", None, 5), (3, "Hello <|endoftext|> wörld", "de", 6), (3, "Hello <|endoftext|> wörld", "de", 6), (None, "x" * 50_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs).collect()))
    tokens = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i or 0, len((t or "").encode()), tokens(t), tokens(t) > 1024) for i, t, *_ in rows)
    coded = {r.doc_id: r for r in bpe.encode(docs, ids="array", decoded=True).collect()}
    assert coded[3].ids == library.encode(rows[2][1], add_special_tokens=False).ids
    assert coded[3].decoded == rows[2][1] and coded[1].n_tokens == 0
    assert coded[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert coded[3].decoded_sha256 == hashlib.sha256(rows[2][1].encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0 and token_count.count_tokens(docs.limit(0)).count() == 0
