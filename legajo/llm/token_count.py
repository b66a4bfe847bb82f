"""Operator 7: token counts, huge documents by overlap resynchronisation.

Free style (mapInArrow, no shuffle). Short documents are encoded whole. A document beyond ``chunk`` characters
is encoded in overlapping chunks with offsets; two neighbours are spliced at a boundary that both encodings
have inside the overlap and that is proven stable (``Boundaries``): the pre-tokeniser splits there whatever stands further off. If no such
boundary aligns, the overlap doubles; if none does in the whole chunk, the chunk itself doubles, so a stretch without any boundary (one
huge word) is encoded in one piece and nothing else is. Null texts count as empty (0 tokens); repeated rows and ids repeat; other columns
are ignored; an empty table stays empty.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from legajo.llm.bpe import vocabulary_path
from legajo.llm.common import map_texts

CHUNK, OVERLAP = 1 << 15, 256


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=2)
def _boundaries(path: str) -> Boundaries:
    return Boundaries(path)


def _class(c: str) -> str:
    """s (blank), L (letter), N (number) or O of a character; empty where Unicode versions may differ."""
    if c.isspace():
        return "s"
    now, then = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]
    return "" if now != then or now == "C" else now if now in "LN" else "O"


class Boundaries:
    """Stable boundaries of one vocabulary's pre-tokeniser.

    The byte-level scheme's words are an optional space and a run of letters, of numbers or of others, a contraction (an apostrophe and
    letters) or a run of blanks. Whatever stands around, a word that has a letter at its end ends before what is no letter; one that has a number at its
    end ends before what is no number; a run of others ends before a letter, number or blank, unless its last is an apostrophe, which may begin a contraction.
    Blanks may belong to what follows them, so no boundary after one is used. For other schemes only a single space between two ASCII letters counts.
    Special strings of the vocabulary are cut out first, so nothing near one counts.
    """

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else {}
        scheme = spec.get("pre_tokenizer") or {}
        self.by_class = scheme.get("type") == "ByteLevel" and bool(scheme.get("use_regex", True)) and not scheme.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def stable(self, text: str, at: int) -> bool:
        """Whether every split of a text that covers ``at`` and its neighbours has a boundary there."""
        if not 0 < at < len(text) - 1:
            return False
        a, b = text[at - 1], text[at]
        if not self.by_class:
            fine = b == " " and a.isascii() and a.isalpha() and text[at + 1].isascii() and text[at + 1].isalpha()
        else:
            x, y = _class(a), _class(b)
            fine = bool(x and y) and x != "s" and x != y and not (a == "'" and x == "O")
        return fine and not any(s in text[max(0, at - len(s) - 2) : at + len(s) + 2] for s in self.special)

    def within(self, text: str, start: int, stop: int) -> list[int]:
        return [i for i in range(max(1, start), min(stop, len(text) - 1)) if self.stable(text, i)]


def count_long(library, text: str, boundaries: Boundaries, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks; equals the count of the whole text."""
    total, at, skip = 0, 0, 0  # skip: characters of the chunk that an earlier one has counted
    end = min(chunk, len(text))
    left = library.encode(text[:end], add_special_tokens=False).offsets
    while end < len(text):
        wide, cut, looked = overlap, None, end
        while cut is None:
            start = max(end - wide, at + skip)
            places = boundaries.within(text, start + 2, min(looked, end - 1))
            looked = start + 2
            if places:
                stop = min(len(text), start + max(chunk, 2 * (end - start)))
                right = library.encode(text[start:stop], add_special_tokens=False).offsets
                # a token's offset may leave out the space before it
                ours, theirs = ({x for a, b in got for x in (a + at_, b + at_)} for got, at_ in ((left, at), (right, start)))
                both = [p for p in places if p in ours and p in theirs]
                cut = both[len(both) // 2] if both else None
            if start == at + skip:
                break
            wide *= 2
        if cut is None:  # nothing to splice at: a longer chunk
            end = min(len(text), at + 2 * (end - at))
            left = library.encode(text[at:end], add_special_tokens=False).offsets
            continue
        total += sum(1 for a, _ in left if skip <= a and a + at < cut)
        left, at, end, skip = right, start, stop, cut - start
    return total + sum(1 for a, _ in left if a >= skip)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every whole text."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        library, texts = _library(path), batch.column("text").to_pylist()
        if path.endswith(".model"):  # the piece model has no offsets into the raw text to splice at
            counts = [len(library.encode(t)) for t in texts]
        else:
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for i, e in zip(short, library.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                counts[i] = len(e)
            for i in set(range(len(texts))) - set(short):
                counts[i] = count_long(library, texts[i], _boundaries(path), chunk, overlap)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
            }
        )

    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
