"""Operator 8, BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

Each leaf of a word's tree holds the rank of the pair that starts at that symbol; the root is the
lowest rank, and descending to the left child while it holds the root's value finds the leftmost
such pair. A merge changes three leaves, and each change climbs to the root in logarithmic time,
until the root says that no pair can merge. Trees of many distinct words are laid side by side in
arrays, so that one step merges one pair of every word at once.

Scale: rows are encoded where they are read (no shuffle); a task handles about ``SLICE_BYTES`` of
text at once and each distinct word of that part once, so memory follows the part, not the table.

Edge cases: a null text counts as empty and gives zero tokens; a long word without spaces is one
tree; repeated rows give equal rows; extra columns are kept by ``encode``'s caller.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .text import Words, filled, slices, table

NONE = np.int64(1 << 40)
#: Elements of the trees that are worked on at once.
TREE_CELLS = 1 << 22
#: Words of these letters are known to be unchanged by NFC; all others go through the library.
PLAIN = regex.compile("[\\x21-\\x7E\\u00A1-\\u012F\\u0131-\\u024F]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merge table of a BPE vocabulary, as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it can't merge (a symbol below 0 stands for none)."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[at] == want) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and the offsets of each word's."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols = self.inner[flat]
        full = sizes > 0
        symbols[starts[1:][full] - 1] = self.last[flat[starts[1:][full] - 1]]
        keep = np.ones(len(symbols), bool)
        width = 2
        todo = np.flatnonzero(sizes > 1)
        while len(todo):
            now, todo = todo[sizes[todo] <= width], todo[sizes[todo] > width]
            step = max(1, TREE_CELLS // (2 * width))
            for lo in range(0, len(now), step):
                part = now[lo : lo + step]
                at = starts[part][:, None] + np.arange(width)[None, :]
                there = np.arange(width)[None, :] < sizes[part][:, None]
                sym, alive = self._merge(np.where(there, symbols[np.minimum(at, len(symbols) - 1)], -1), there, width)
                symbols[at[there]] = sym[there]
                keep[at[there]] = alive[there]
            width *= 2
        left = np.bincount(np.repeat(np.arange(len(words)), sizes)[keep], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        return symbols[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(left)]).astype(np.int64)

    def _merge(self, sym: np.ndarray, alive: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of sym (one word each, -1 beyond its end) to the end."""
        n = len(sym)
        alive = alive.copy()
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        padded = np.concatenate([sym, np.full((n, 1), -1)], 1)  # the column beyond the end stands for "no symbol"
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self.ranks(padded[:, :-1], padded[:, 1:])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        depth = width.bit_length() - 1
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            best = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node
                node += tree[rows, node] != best
            i = node - width
            j = nxt[rows, i]
            after = nxt[rows, j]
            padded[rows, i] = self.made[best]
            alive[rows, j] = False
            nxt[rows, i] = after
            inside = after < width
            prv[rows[inside], after[inside]] = i[inside]
            self._set(tree, rows, j, np.full(len(rows), NONE), width)
            self._set(tree, rows, i, self.ranks(padded[rows, i], padded[rows, after]), width)
            before = prv[rows, i]
            has = before >= 0
            r, b = rows[has], before[has]
            self._set(tree, r, b, self.ranks(padded[r, b], padded[r, i[has]]), width)
            rows = rows[tree[rows, 1] < NONE]
        return padded[:, :width], alive

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2


def ragged(flat: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number take[0], take[1], ... of a ragged array, one after another, and their offsets."""
    sizes = np.diff(offsets)[take]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(offsets[:-1][take] - out[:-1], sizes) + np.arange(out[-1])], out


class WordBpe:
    """Encoder for a tokenizer file of lower-cased words with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.bytes_of = {c: b for b, c in byte_letters().items()}

    def pieces(self, chunk: str) -> list:
        """The pre-tokens of one chunk without white space: bytes, or an added token's id."""
        if "<|" in chunk and self.special.search(chunk):
            return [y for x in self.special.split(chunk) if x for y in ([self.added[x]] if x in self.added else self.pieces(x))]
        if PLAIN.fullmatch(chunk):
            return [x.encode() for x in self.pattern.findall(chunk.lower())]
        return [bytes(self.bytes_of[c] for c in x) for x, _ in self.split(self.normalize(chunk))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text's."""
        w = Words(texts)
        known: dict = {}
        numbers: list[int] = []
        sizes = np.zeros(len(w.words), np.int64)
        for k, chunk in enumerate(w.words.to_pylist()):
            own = self.pieces(chunk)
            sizes[k] = len(own)
            for x in own:
                numbers.append(known.setdefault(x, len(known)))
        pieces = list(known)
        fixed = [(i, x) for i, x in enumerate(pieces) if isinstance(x, int)]
        ids, at = self.merges.encode([b"" if isinstance(x, int) else x for x in pieces])
        if fixed:
            lists = [ids[at[i] : at[i + 1]] for i in range(len(pieces))]
            for i, x in fixed:
                lists[i] = np.array([x], np.uint32)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            ids = np.concatenate(lists)
        of_chunk, chunk_at = ragged(ids, at, np.array(numbers, np.int64))
        ends = chunk_at[np.concatenate([[0], np.cumsum(sizes)])]
        out, word_at = ragged(of_chunk, ends, w.ids)
        return out, word_at[w.offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Token strings with a space between, which is what this kind of file decodes to."""
        tokens = self.names.take(pa.array(ids))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens), pa.scalar(" ", pa.large_string()))


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, token ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = bpe.encode(filled(part.column("text")))
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists.cast(pa.list_(pa.int64())), bpe.decode(ids, at).cast(pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.selectExpr(f"`{id_column}` as id", f"`{text}` as text").mapInArrow(run, f"id {kind}, ids array<bigint>, decoded string").withColumnRenamed("id", id_column)


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded texts, taken in the task so that only digests leave it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = bpe.encode(filled(part.column("text")))
                raw = ids.astype("<u4")
                decoded = bpe.decode(ids, at).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array([sha(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]), pa.array([sha(x) for x in decoded.to_pylist()])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
