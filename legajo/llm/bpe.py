"""Operator 10: byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The main path is free style (mapInArrow, no shuffle): each batch's distinct pre-tokens are merged at once in
numpy. Every word has a segment tree whose leaves are the ranks of its adjacent pairs and whose nodes are
minima of (rank, position); the root is the leftmost lowest-ranked merge. A merge rewrites three leaves and
their paths, until the root shows that no pair can merge. Words of over ``LONG`` bytes have a tree of plain integers each, whose updates
end at the first node that keeps its minimum; they cost about n log n steps and 50 bytes a byte. Null texts count as empty (no tokens), ties of rank
go to the leftmost pair, rows repeat as they come, other columns are ignored, and an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from legajo.llm.common import map_texts

NONE = np.int64(1) << np.int64(62)
#: Distinct pre-tokens that a worker remembers before it forgets them all.
CACHE = 150_000
#: Bytes from which a word is merged by itself, and not remembered.
LONG = 512
#: Pre-token pattern of the byte-level scheme (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves if printable, else the letters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SegmentTreeBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PATTERN)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, bytes] = {}
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        top = max(self.bytes_of) + 1
        self.table = [self.bytes_of.get(i, b"") for i in range(top)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; a very high one where the pair has no merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE >> 24)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word (little-endian unsigned 32-bit); words of like length share their numpy steps."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        depth = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._tree(words[i])
        for d in np.unique(depth[sizes <= LONG]):
            rows = np.flatnonzero((depth == d) & (sizes <= LONG))
            step = max(1, (1 << 18) >> d)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part.tolist(), self._trees([words[i] for i in part.tolist()], 1 << int(d)), strict=True):
                    out[i] = ids
        return out

    def _tree(self, word: bytes) -> bytes:
        """The ids of one long word; the tree's nodes are rank * leaves + position of the least pair below them."""
        n = len(word)
        leaves = 1 << max(1, (n - 1).bit_length())
        start = self.of_byte[np.frombuffer(word, np.uint8)]
        none = int(NONE >> 24)
        least = np.full(2 * leaves, none * leaves, np.int64)
        least[leaves : leaves + n - 1] = self.rank(start[:-1], start[1:]) * leaves
        least[leaves:] += np.arange(leaves)
        for k in range(leaves.bit_length() - 2, -1, -1):
            least[1 << k : 2 << k] = np.minimum(least[2 << k : 4 << k : 2], least[(2 << k) + 1 : 4 << k : 2])
        tree, ids = array("q", least.tobytes()), array("q", start.astype(np.int64).tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        merged, rank_of, width, high = self.merged.tolist(), self.rank_of, self.width, none * leaves
        while tree[1] < high:
            rank, at = divmod(tree[1], leaves)  # the root: leftmost pair of the lowest rank
            right = after[at]
            follow = after[right]
            ids[at], ids[right], after[at] = merged[rank], -1, follow
            changed = [(right, none), (at, rank_of.get(ids[at] * width + ids[follow], none) if follow < n else none)]
            if follow < n:
                before[follow] = at
            if (left := before[at]) >= 0:
                changed.append((left, rank_of.get(ids[left] * width + ids[at], none)))
            for leaf, r in changed:
                node, value = leaf + leaves, r * leaves + leaf
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    if other < value:
                        value = other
                    if tree[node] == value:
                        break
                    tree[node] = value
        flat = np.frombuffer(ids, np.int64)
        return flat[flat >= 0].astype("<u4").tobytes()

    def _trees(self, words: list[bytes], leaves: int) -> list[bytes]:
        n = len(words)
        sizes = np.array([len(w) for w in words])
        inside = np.arange(leaves) < sizes[:, None]
        ids = np.full((n, leaves + 1), -1, np.int64)
        ids[:, :leaves][inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))  # the next living symbol
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.empty((n, 2 * leaves), np.int64)
        tree[:, leaves:] = self.rank(ids[:, :-1], ids[:, 1:]) * leaves + np.arange(leaves)
        for k in range(leaves.bit_length() - 2, -1, -1):
            tree[:, 1 << k : 2 << k] = np.minimum(tree[:, 2 << k : 4 << k : 2], tree[:, (2 << k) + 1 : 4 << k : 2])
        none = (NONE >> 24) * leaves
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            rank, at = np.divmod(tree[live, 1], leaves)  # the root: leftmost pair of the lowest rank
            right = after[live, at]
            ids[live, at] = self.merged[rank]
            ids[live, right] = -1
            follow = after[live, right]
            after[live, at] = follow
            before[live, np.minimum(follow, leaves)] = at
            self._update(tree, live, right, np.full(len(live), NONE >> 24), leaves)
            beyond = np.where(follow <= leaves, ids[live, np.minimum(follow, leaves)], -1)
            self._update(tree, live, at, self.rank(ids[live, at], beyond), leaves)
            left = before[live, at]
            has = left >= 0
            rows, left = live[has], left[has]
            self._update(tree, rows, left, self.rank(ids[rows, left], ids[rows, at[has]]), leaves)
            live = live[tree[live, 1] < none]
        keep = ids[:, :leaves] >= 0
        flat, ends = ids[:, :leaves][keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray, leaves: int) -> None:
        node = leaf + leaves
        tree[rows, node] = rank * leaves + leaf
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves >>= 1

    def encode_batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of each text, special strings of the vocabulary as one token."""
        pieces: list[list[str]] = []
        for text in texts:
            parts = self.split.split(text) if self.split else [text]
            if len(parts) == 1:
                pieces.append(self.pieces.findall(text))
            else:
                pieces.append([p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pieces.findall(part))])
        if len(self.cache) > CACHE:
            self.cache.clear()
        known = self.cache
        new = list(set().union(*pieces) - known.keys() - self.special.keys())
        known |= zip(new, self.merge([w.encode() for w in new]), strict=True)
        known |= self.special
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), "<u4") for p in pieces]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


def encode(docs: DataFrame, path: str | None = None, ids: str = "none", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text.

    ids: "array" or "binary" (little-endian unsigned 32-bit) adds the ids; decoded adds the decoded text.
    """
    path = path or vocabulary_path()
    kinds = {"none": "", "array": ", ids array<long>", "binary": ", ids binary"}
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + kinds[ids] + ", decoded string" * decoded

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        coded = bpe.encode_batch(batch.column("text").to_pylist())
        texts = [bpe.decode(x) for x in coded]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(x) for x in coded], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        }
        if ids == "array":
            out["ids"] = pa.array([x.tolist() for x in coded], pa.list_(pa.int64()))
        if ids == "binary":
            out["ids"] = pa.array([x.tobytes() for x in coded], pa.binary())
        if decoded:
            out["decoded"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict(out)

    docs = docs.withColumn("doc_id", docs["doc_id"].cast("long"))
    return map_texts(docs, ["doc_id", "text"], run, schema, lambda: encoder(path).cache.clear())
