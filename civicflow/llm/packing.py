"""Packing documents into token sequences along a space-filling curve.

Each document's tokens are hashed into a short vector, projected to three
dimensions and placed on a Hilbert curve. Documents are range-sorted by their
place on the curve and laid end to end, so neighbours in a sequence are alike;
a sequence is cut whenever it is full. What is left at the end of a partition is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state, written

DIMS, BITS, HASHED = 3, 10, 256

#: Fixed value: where byte-level pre-tokenizers cut (the published pattern of this vocabulary).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(n, dims) cell numbers below 2**bits -> place on the Hilbert curve (Skilling 2004, all rows at once)."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its number where
    that is printable, and the others, in order, as those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ranked_encoder(byte_bpe: str) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same vocabulary: byte pairs are merged by rank, which the
    ids are where the file lists its merges in the order of the ids they make. None for other files."""
    import tiktoken

    with open(byte_bpe, encoding="utf-8") as f:
        parts = json.load(f)
    before, model = parts.get("pre_tokenizer") or {}, parts["model"]
    if (parts.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or model.get("type") != "BPE"):
        return None
    vocab, bytes_of = model["vocab"], {letter: bytes([byte]) for byte, letter in byte_letters().items()}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in model["merges"]]
    added = {t["content"] for t in parts.get("added_tokens") or []}
    plain = {token: i for token, i in vocab.items() if token not in added}
    if any(x >= y for x, y in zip(made, made[1:])) or len(made) + 256 != len(plain) or min(made, default=0) < 256:
        return None
    ranks = {b"".join(map(bytes_of.__getitem__, token)): i for token, i in plain.items()}
    return tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordCache:
    """Token ids of a text, word by word.

    A byte-level pre-tokenizer never lets a piece span the place before a single
    space or line feed that stands between two other characters, so a text's ids
    are those of its words, each with the space or line feed before it. Ids of
    frequent words are kept. New words with letters of the Latin blocks go through the
    vocabulary's ranks; those with other letters, where pattern libraries may differ, go
    through the whole tokenizer, and so do texts with other white space, texts
    that contain an added token (``<|endoftext|>``) and other tokenizers."""

    LATIN = "\u0250"

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.most, self.known = most, {}
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self.fast = ranked_encoder(path)
        self.ends = {sign: self._ranked(sign) for sign in ",."} if self.fast else {}

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ranked(self, chunk: str) -> bytes:
        return array(self.kind, self.fast(chunk)).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word that follows a space or begins with a line feed; None where it has other white space."""
        if word[-1:] in self.ends and word[:-1].isalpha() and max(word) < self.LATIN:    # not kept: its letters are
            return (self.known.get(word[:-1]) or self._word(word[:-1])) + self.ends[word[-1]]
        feed = word[:1] == "\n"
        got = self._chunk(word if feed else " " + word, word[1:] if feed else word)
        if got is not None and len(self.known) < self.most:
            self.known[word] = got
        return got

    def _chunk(self, chunk: str, body: str) -> bytes | None:
        if body.split() != [body]:
            return None
        return self._ranked(chunk) if max(chunk) < self.LATIN else self._whole(chunk)

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(token in text for token in self.added):
            return self._whole(text)
        words = text.replace("\n", " \n").split(" ")
        found = list(map(self.known.get, words))
        found[0] = None if words[0][:1] == "\n" else self._chunk(words[0], words[0])
        if found[0] is None:
            return self._whole(text)
        at = 0
        for _ in range(found.count(None)):
            at = found.index(None, at)
            found[at] = self._word(words[at])
            if found[at] is None:
                return self._whole(text)
        return b"".join(found)


def _place(ids: list[np.ndarray], bucket: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its token ids."""
    hashed = np.stack([np.bincount(bucket[i], minlength=HASHED) for i in ids]).astype(np.float64)
    hashed = np.sqrt(hashed / np.maximum(hashed.sum(axis=1, keepdims=True), 1))     # unit length
    cells = np.clip(((hashed @ axes) / 3 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)  # three deviations either way
    return hilbert_key(cells.astype(np.int64))


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int,
              cached_words: int, seed: int = 3) -> DataFrame:
    """(id, row, key, ids): token ids with the end mark, and the place on the curve."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(f"{cached_words} word ids of {tokenizer_path}", lambda: WordCache(tokenizer_path, cached_words))
        row = TaskContext.get().partitionId() << 32
        rng = np.random.default_rng(seed)
        bucket = rng.integers(0, HASHED, max(cache.tokenizer.get_vocab_size(), end_id + 1))
        axes = rng.normal(0, 0.5, (HASHED, DIMS))
        end = np.array([end_id], cache.dtype).tobytes()
        for part in parts:
            sizes = np.cumsum([s.as_buffer().size if s.is_valid else 0 for s in part.column("_text")])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // (1 << 21))) + 1).tolist(), part.num_rows]
            for a, z in zip(cuts, cuts[1:]):                 # about 2 MB of text at a time
                if a == z:
                    continue
                ids = [cache.ids(t.as_py() or "") + end for t in part.column("_text")[a:z]]
                key = _place([np.frombuffer(x, cache.dtype) for x in ids], bucket, axes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id")[a:z], pa.array(np.arange(row, row + z - a)), pa.array(key),
                     pa.array(ids, pa.binary())], names=["_id", "_row", "_key", "_ids"])
                row += z - a

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(batches, "_id long, _row long, _key long, _ids binary")


class Packer:
    """Lays documents end to end into sequences of ``size``; ``done`` collects finished pieces."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.used = size, first, 0
        self.open: list[tuple] = []          # pieces of the sequence being filled: (doc, start, ids, doc tokens)
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.done.append((doc, start, len(ids), crc, total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start:start + self.size - self.used]
            self.open.append((doc, start, part, len(ids)))
            self.used += len(part)
            start += len(part)
            if self.used == self.size:
                self._close(self.open)
                self.open, self.used = [], 0

    def finish(self) -> None:
        """Cut the open sequence into lengths that are powers of two, the largest first."""
        rest = self.open
        while self.used:
            length = 1 << (self.used.bit_length() - 1)
            pieces, room = [], length
            while room:
                doc, start, ids, total = rest[0]
                pieces.append((doc, start, ids[:room], total))
                rest = rest[1:] if len(ids) <= room else [(doc, start + room, ids[room:], total), *rest[1:]]
                room -= len(pieces[-1][2])
            self._close(pieces)
            self.used -= length
        self.open = []


PIECES = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str,
                   size: int = 2048, end_id: int = 1, cached_words: int = 250_000) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's tokens are its text's ids and ``end_id``, so a null or empty
    text has one token. A document is cut where a sequence is full; its tokens
    each lie in one piece. Rows with a null id and repeated rows are packed like
    any other, each on its own. An empty table gives no rows. Other columns are
    not looked at. ``tokenizer_path`` must exist on every executor. ``cached_words``
    bounds the words that a Python worker keeps (about 200 bytes each): fewer save
    memory and cost time, the result is the same.

    Equal places on the curve (copies) are ordered by id and row number, which
    the range sort uses too, so a large group of copies spreads over partitions.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = written(tokenised(docs, id_col, text_col, tokenizer_path, end_id, cached_words))
    wide = int(WordCache(tokenizer_path).dtype.itemsize)
    order = ["_key", "_id", "_row"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.done)) or [[]] * len(schema)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for part in parts:
            for doc, ids in zip(part.column("_id"), part.column("_ids")):
                packer.add(doc.as_py(), np.frombuffer(ids.as_buffer(), f"<u{wide}"))
                if len(packer.done) >= 10_000:
                    yield flush()
        packer.finish()
        yield flush()

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = sorted_rows.select("_id", "_ids").mapInArrow(batches, PIECES)
    return packed.withColumnRenamed("_id", id_col)
