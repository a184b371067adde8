"""Encoding of texts with a public byte-level BPE tokenizer, by a tree of joined halves."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, the same on all executors.
FOLDER = "/opt/tokenizers"

# Fixed value: how byte-level BPE vocabularies of this family cut a text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Characters of a leaf of the tree, and of the first window at a seam; ids of a leaf when decoding.
LEAF, WINDOW, LEAF_IDS = 1 << 10, 32, 1 << 10

# Letters, digits, marks and white space on which all versions of Unicode agree.
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_MARK = r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff08-\uff0c\uff1a\uff1b\uff1f"
_SPACE = r" \t\n\r"

# Places where a word of PATTERN ends whatever comes before or after them: no word runs from a visible character into
# white space, from a letter or a digit into another kind, or from a mark other than ' into a letter or digit.
_CUT = regex.compile(rf"(?<=[{_LETTER}{_DIGIT}{_MARK}'])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}{_DIGIT}])")


class ByteBPE:
    """A vocabulary of ranks, and the length in bytes of each of its tokens."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.width = np.array([len(t or b"") for t in self.bytes], np.int32)

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), np.int32)

    def ids(self, text: str | None, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
        """Token ids of a text; none for None and ''.

        Halves are encoded by themselves, down to pieces of at most leaf characters, and joined. The result is that of
        encoding the text at once, for any leaf and window.
        """
        if not text:
            return np.empty(0, np.int32)
        return np.concatenate(self.tree(text, 0, len(text), leaf, window))

    def tree(self, text: str, lo: int, hi: int, leaf: int, window: int) -> list[np.ndarray]:
        if hi - lo <= leaf:
            return [self.leaf(text[lo:hi])]
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.tree(text, lo, mid, leaf, window), self.tree(text, mid, hi, leaf, window), window)

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[np.ndarray], right: list[np.ndarray], window: int) -> list[np.ndarray]:
        """Encode again what lies between the nearest certain word ends on both sides of the seam.

        The window grows until it holds a certain end on each side, or reaches the end of the half. A word ends there
        in the half and in the whole alike, and words are encoded one by one: tokens outside can't change.
        """
        size = window
        while True:
            start = max(lo, mid - size)
            ends = [m.start() for m in _CUT.finditer(text, start, mid) if start < m.start() < mid] if start > lo else []
            if start > lo and not ends:
                # the place at `start` itself is not tested: its left neighbour is outside of the window
                size *= 2
                continue
            a = lo if start == lo else ends[-1]
            break
        size = window
        while True:
            stop = min(hi, mid + size)
            first = next((m.start() for m in _CUT.finditer(text, mid, stop) if mid < m.start() < stop), None)
            if first is None and stop < hi:
                size *= 2
                continue
            b = hi if first is None else first
            break
        middle = self.leaf(text[a:b])
        return [*self.drop_last(left, len(text[a:mid].encode())), middle, *self.drop_first(right, len(text[mid:b].encode()))]

    def drop_last(self, parts: list[np.ndarray], size: int) -> list[np.ndarray]:
        parts = list(parts)
        while size and parts:
            widths = np.cumsum(self.width[parts[-1]][::-1])
            whole = int(widths[-1]) if widths.size else 0
            if whole <= size:
                size -= whole
                parts.pop()
            else:
                k = int(np.searchsorted(widths, size)) + 1
                parts[-1] = parts[-1][:-k]
                break
        return parts

    def drop_first(self, parts: list[np.ndarray], size: int) -> list[np.ndarray]:
        return [p[::-1] for p in self.drop_last([p[::-1] for p in parts[::-1]], size)][::-1]

    def text(self, ids: np.ndarray, leaf: int = LEAF_IDS) -> str:
        """The text that has these ids; halves are decoded by themselves and their bytes concatenated up the tree.

        Bytes that are not UTF-8, which no encoded text has, become U+FFFD. Raises LookupError for an unknown id.
        """
        return self.bytes_of(ids, 0, len(ids), leaf).decode(errors="replace")

    def bytes_of(self, ids: np.ndarray, lo: int, hi: int, leaf: int) -> bytes:
        if hi - lo > leaf:
            mid = (lo + hi) // 2
            return self.bytes_of(ids, lo, mid, leaf) + self.bytes_of(ids, mid, hi, leaf)
        part = ids[lo:hi]
        if part.size and not (0 <= part.min() and part.max() < len(self.bytes) and self.width[part].all()):
            raise LookupError("an id that the vocabulary doesn't have")
        return b"".join([self.bytes[i] for i in part.tolist()])


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = FOLDER) -> ByteBPE:
    return ByteBPE(f"{folder}/{name}.tiktoken")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, name: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF) -> DataFrame:
    """key and ids, the token ids of each text without special tokens; an empty list for null and for empty texts.

    One pass without any exchange. Special tokens' strings in a text are ordinary text. Texts of any length are encoded
    whole. Rows with a null or repeated key are kept as they are; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            for at, texts in _portions(batch.column(1)):
                lists = [bpe.ids(t, leaf) for t in texts]
                ends = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype(np.int32)
                flat = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _portions(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """Successive rows with about size characters in all, and where they begin."""
    at, held, total = 0, [], 0
    for i, value in enumerate(texts):
        held.append(value.as_py())
        total += len(held[-1] or "")
        if total >= size:
            yield at, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, held


def count(docs: DataFrame, *, text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF) -> DataFrame:
    """docs without text, with n_tokens: the number of ids that encode() gives."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            sizes = [bpe.ids(t, leaf).size for _, texts in _portions(batch.column(len(keep))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*[F.col(c) for c in keep], text).mapInArrow(run, f"{schema}, n_tokens long")


def decode(coded: DataFrame, key: str = "doc_id", ids: str = "ids", *, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key and text, of the ids that encode() gives; '' for an empty list, null for null and for ids that aren't known.

    One pass without any exchange; rows with null or repeated keys are kept, other columns are ignored.
    """
    kind = coded.schema[key].dataType.simpleString()

    def one(bpe: ByteBPE, value: pa.Scalar) -> str | None:
        if not value.is_valid or value.values.null_count:
            return None
        try:
            return bpe.text(value.values.to_numpy())
        except LookupError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(bpe, v) for v in part.column(1)], pa.string())], [key, "text"])

    return coded.select(key, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
