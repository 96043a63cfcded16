"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B).
An interval of tokens whose bytes agree is split at a byte offset near its middle
where a token of both ends: the offset is bisected for among B's ends, and
looked for in ever wider windows around the middle. Both halves are split again;
an interval without such an offset is a group. All intervals of a block of
documents are split at the same time, a round for each depth.

Documents are kept in blocks of some megabytes of text. What leaves a block for the
corpus-wide counts is one row per distinct pair of token ids in the block, and what comes
back is one row per block, so no shuffle carries a row per document and pair.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state, written
from .packing import byte_letters, ranked_encoder

SPACE = "▁"             # fixed value: how piece vocabularies write a space
NARROW = 4096                # id pairs of a group up to which all its links are laid out one by one


class TwoTokenizers:
    """Ids of texts by both tokenizers, word by word where that is the same.

    Neither tokenizer has a token that spans the place before a single space or line
    feed between two other characters (checked on the piece vocabulary when it is
    read), so the ids of a text are those of its words, each with the space or line
    feed before it. The distinct words of a block are encoded once. Texts with other
    white space go through both tokenizers whole."""

    LATIN = "\u0250"                       # below it, pattern libraries agree on letters, digits and white space

    def __init__(self, byte_bpe: str, piece_model: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), SentencePieceProcessor(model_file=piece_model)
        self.a.encode_special_tokens = True            # their strings in a text are plain text
        bytes_of = {letter: bytes([byte]) for byte, letter in byte_letters().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = [b"".join(bytes_of.get(c, c.encode()) for c in self.a.id_to_token(i) or "")
                        for i in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.fast = ranked_encoder(byte_bpe)
        self.most, self.known_a, self.known_b = most, {}, {}

    def _ids_a(self, chunks: list[str]) -> list[list[int]]:
        out = [self.fast(c) if self.fast and max(c) < self.LATIN else None for c in chunks]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.a.encode_batch([chunks[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each chunk, which begins with a space or a line feed; None if its bytes don't come back."""
        if not chunks:
            return []
        lists_a = self._ids_a(chunks)
        lists_b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        space = self.b.piece_to_id(SPACE)              # B puts it before every text
        lists_b = [b[1:] if c[0] == "\n" and b[:1] == [space] else b for c, b in zip(chunks, lists_b)]
        wanted = [c.encode() for c in chunks]
        lengths, good, cut = np.fromiter(map(len, wanted), np.int64, len(wanted)), np.ones(len(chunks), bool), []
        for lists, spelled, sizes in ((lists_a, self.bytes_a, self.size_a), (lists_b, self.bytes_b, self.size_b)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            upto = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum(n)]
            if not np.array_equal(upto, np.cumsum(lengths)) or b"".join(map(spelled.__getitem__, flat.tolist())) != b"".join(wanted):
                good &= [b"".join(map(spelled.__getitem__, ids)) == w for ids, w in zip(lists, wanted)]
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            cut.append([data[i:j] for i, j in zip([0, *ends], ends)])
        return [(a, b) if ok else None for a, b, ok in zip(*cut, good.tolist())]

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether white space stands in a word at most as one line feed before it."""
        body = word[1:] if word[:1] == "\n" else word
        return body.split() == [body]

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Ids of space + text by A and by B (little-endian, four bytes each); None where there
        is no text or they don't spell it."""
        words = [t.replace("\n", " \n").split(" ") if t and self.by_word and t[0] != "\n" else [""] for t in texts]
        new = {w for w in chain.from_iterable(words) if w not in self.known_a}
        plain = [w for w in new if self._plain(w)]
        found = {w: got for w, got in zip(plain, self._encode([w if w[0] == "\n" else " " + w for w in plain])) if got}
        new_a, new_b = {w: got[0] for w, got in found.items()}, {w: got[1] for w, got in found.items()}
        room = self.most - len(self.known_a)
        if room >= len(new_a):
            self.known_a.update(new_a)
            self.known_b.update(new_b)
            of_a, of_b = self.known_a.get, self.known_b.get
        else:
            for w in list(new_a)[:room]:
                self.known_a[w], self.known_b[w] = found[w]
            of_a, of_b = (lambda w, own=own, new=new: own.get(w) or new.get(w)
                          for own, new in ((self.known_a, new_a), (self.known_b, new_b)))
        out: list = []
        for own in words:
            a = list(map(of_a, own))
            out.append(None if None in a else (b"".join(a), b"".join(map(of_b, own))))
        whole = [k for k, got in enumerate(out) if got is None and texts[k]]
        for k, got in zip(whole, self._encode([" " + texts[k] for k in whole])):
            out[k] = got
        return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first[k], first[k] + 1, ...`` (``count[k]`` of them) for every k in a row, and where each k begins."""
    begin = np.cumsum(count) - count
    return np.repeat(first - begin, count) + np.arange(int(count.sum())), begin


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray,
                b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks on the tokens of A and B that end where the other's end too.

    ``ends_*`` are ascending byte offsets; the intervals [a0, a1) x [b0, b1) of token
    numbers end at the same offset and are split independently."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut_a[a1 - 1] = cut_b[b1 - 1] = True
    reach = np.zeros(len(a0), np.int64)
    far = np.iinfo(np.int64).max
    while True:
        inner = (a1 - a0 > 1) & (b1 - b0 > 1)         # others have no end inside: groups
        a0, a1, b0, b1, reach = (x[inner] for x in (a0, a1, b0, b1, reach))
        if not len(a0):
            return cut_a, cut_b
        mid = (a0 + a1 - 2) // 2
        low, high = np.maximum(mid - reach, a0), np.minimum(mid + reach, a1 - 2)
        at, begin = _spread(low, high - low + 1)
        place = np.searchsorted(ends_b, ends_a[at])
        away = at - np.repeat(mid, high - low + 1)
        order = np.where(ends_b[place] == ends_a[at], 2 * np.abs(away) + (away > 0), far)
        nearest = np.minimum.reduceat(order, begin)
        hit = nearest < far
        i = mid[hit] + np.where(nearest[hit] % 2 == 1, nearest[hit] // 2, -(nearest[hit] // 2))
        j = place[begin[hit] + i - low[hit]]
        cut_a[i] = cut_b[j] = True
        again = hit | (low > a0) | (high < a1 - 2)    # the others are groups; the unhit ones look wider
        # halves stay in the order of the text, so that the next offsets looked up ascend
        count = again.astype(np.int64) + hit
        slot = np.cumsum(count) - count
        left, right = slot[hit], slot[hit] + 1
        first = slot[again]
        total = int(count.sum())
        n_a0, n_a1, n_b0, n_b1, n_reach = (np.zeros(total, np.int64) for _ in range(5))
        for new, old in ((n_a0, a0), (n_a1, a1), (n_b0, b0), (n_b1, b1)):
            new[first] = old[again]
        n_reach[first] = np.where(hit, 0, 4 * reach + 1)[again]
        n_a1[right], n_b1[right] = a1[hit], b1[hit]
        n_a1[left], n_b1[left], n_a0[right], n_b0[right] = i + 1, j + 1, i + 1, j + 1
        a0, a1, b0, b1, reach = n_a0, n_a1, n_b0, n_b1, n_reach


def _linked(ids_a, ids_b, first_a, n_a, first_b, n_b, doc, span: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, id pair) of all groups as ``doc * span + a * wide + b``, ascending, and
    how many links each has. Groups that have very many links are taken by their distinct ids."""
    large = n_a * n_b > NARROW
    small = ~large
    size = (n_a * n_b)[small]
    at, begin = _spread(np.zeros(len(size), np.int64), size)
    across = np.repeat(n_b[small], size)
    a = ids_a[np.repeat(first_a[small], size) + at // across]
    b = ids_b[np.repeat(first_b[small], size) + at % across]
    keys, weight = np.repeat(doc[small], size) * span + a * wide + b, None
    if large.any():
        keys, weight = [keys], [np.ones(len(keys), np.int64)]
        for g in np.flatnonzero(large):
            ua, ca = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            ub, cb = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            keys.append((doc[g] * span + ua[:, None] * wide + ub[None, :]).ravel())
            weight.append((ca[:, None] * cb[None, :]).ravel())
        keys, weight = np.concatenate(keys), np.concatenate(weight)
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
    else:
        keys.sort()
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    if weight is None:
        return keys[start], np.diff(start, append=len(keys))
    return keys[start], np.add.reduceat(weight, start)


class Block:
    """Aligned documents of one block: what is kept of each, and the links by distinct id pair."""

    def __init__(self, two: TwoTokenizers, texts: list[str | None]):
        self.two = two
        found = two.ids(texts)
        a = np.frombuffer(b"".join(f[0] for f in found if f), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join(f[1] for f in found if f), "<u4").astype(np.int64)
        self.n_a = np.array([len(f[0]) // 4 if f else 0 for f in found], np.int64)
        self.n_b = np.array([len(f[1]) // 4 if f else 0 for f in found], np.int64)
        to_a, to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        full = self.n_a > 0
        cut_a, cut_b = shared_cuts(np.cumsum(two.size_a[a]), np.cumsum(two.size_b[b]), (to_a - self.n_a)[full], to_a[full],
                                   (to_b - self.n_b)[full], to_b[full])
        last_a, last_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1       # by group
        group_a, group_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        before = np.searchsorted(last_a, to_a, "right")                              # groups up to a document's end
        self.n_groups = np.diff(before, prepend=0)
        links = np.concatenate([[0], np.cumsum(group_a * group_b)])
        self.n_links = links[before] - links[before - self.n_groups]
        wide = len(two.bytes_b)
        span = len(two.bytes_a) * wide
        key, self.links = _linked(a, b, last_a - group_a, group_a, last_b - group_b, group_b,
                                  np.repeat(np.arange(len(texts)), self.n_groups), span, wide)
        self.pairs, self.at = np.unique(key % span, return_inverse=True)
        self.n_docs = np.bincount(self.at, minlength=len(self.pairs))
        self.n_pairs = np.bincount(key // span, minlength=len(texts))
        self._text = (a, b, cut_a, cut_b, last_a, last_b, to_a + to_b)

    def groups(self) -> Iterator[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        a, b, cut_a, cut_b, last_a, last_b, ends = self._text
        na, nb = len(self.two.bytes_a), len(self.two.bytes_b)
        signs = worker_state(f"token ids of {na} and {nb}", lambda: [
            b"%d%s" % (i, end) for n, ends in ((na, (b",", b"|")), (nb, (b",", b";"))) for end in ends for i in range(n)])
        first_a, first_b = np.concatenate([[0], last_a]), np.concatenate([[0], last_b])
        place = np.empty(len(a) + len(b), np.int64)
        place[np.arange(len(a)) + first_b[np.cumsum(cut_a) - cut_a]] = a + na * cut_a
        place[np.arange(len(b)) + first_a[np.cumsum(cut_b) - cut_b + 1]] = b + nb * cut_b + 2 * na
        spelled = list(map(signs.__getitem__, place.tolist()))
        start = 0
        for end in ends.tolist():
            yield b"".join(spelled[start:end])[:-1]
            start = end


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i8").tobytes() if numbers.max(initial=0) >= 1 << 31 else
                         b"4" + numbers.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<i4", offset=1).astype(np.int64) if len(raw) % 4 else np.frombuffer(raw, "<i8")


def _lists(column: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([x.tolist() for x in column], pa.list_(kind))


BLOCKS = ("block long, ids array<long>, groups array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, n_pairs array<long>, at binary, links binary, pairs array<long>, n_docs array<long>")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]


def aligned_blocks(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_model: str, show: Callable[[bytes], str],
                   block_bytes: int, cached_words: int) -> DataFrame:
    """One row per block of about ``block_bytes`` of text (one document, if it is longer)."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = worker_state(f"{cached_words} words of {byte_bpe} and {piece_model}",
                           lambda: TwoTokenizers(byte_bpe, piece_model, cached_words))
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            size = np.cumsum([s.as_buffer().size if s.is_valid else 0 for s in part.column("_text")])
            cuts = [0, *(np.flatnonzero(np.diff(size // block_bytes)) + 1).tolist(), part.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                block = Block(two, part.column("_text")[a:z].to_pylist())
                shown = [show(g) for g in block.groups()]
                at = np.diff(block.at, prepend=0)          # small steps, but for a new document's first
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([part.column("_id")[a:z].to_pylist()], pa.list_(pa.int64())),
                    pa.array([shown], pa.list_(pa.string())),
                    *(_lists([getattr(block, c)], pa.int64()) for c in COUNTS),
                    pa.array([_packed(at)]), pa.array([_packed(block.links)]),
                    _lists([block.pairs], pa.int64()), _lists([block.n_docs], pa.int64())],
                    names=[c.split()[0] for c in BLOCKS.split(", ")])
                number += 1

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(batches, BLOCKS)


def pair_counts(blocks: DataFrame, ids_b: int) -> DataFrame:
    """``pair, count, best``: how many documents hold an id pair (a * ids_b + b) linked, and whether
    no other pair of the same a is in more. One row per pair of the two vocabularies at most."""
    one = F.explode(F.arrays_zip("pairs", "n_docs")).alias("one")
    counts = written(blocks.select(one).groupBy(F.col("one.pairs").alias("pair")).agg(F.sum("one.n_docs").alias("count")))
    # one row per id of A: bounded by its vocabulary
    most = counts.groupBy(F.expr(f"pair div {ids_b}").alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {ids_b}")).join(F.broadcast(most), "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, byte_bpe: str, piece_model: str,
                    show: Callable[[bytes], str] = bytes.decode, block_bytes: int = 1 << 20,
                    cached_words: int = 150_000) -> DataFrame:
    """One row per input row: ``id_col, groups, n_a, n_b, n_groups, n_links, n_best, count_sum``.

    ``groups`` is ``show`` of the document's groups as ``a1,a2|b1;a3|b2,b3`` (ids of A, ids
    of B); by default the text itself. A link is an A-B pair of tokens of one group; its count
    is the number of rows of ``docs`` that hold its id pair linked. ``n_best`` counts links
    whose count is the highest of their A id, ``count_sum`` sums over links.

    Null and empty texts and texts that the tokens of A or B don't spell (with one space
    before them) have no tokens: zeros and the groups of an empty text. Every row
    is a document of its own, repeated rows and rows without an id too. Other columns are not
    looked at; an empty table gives no rows. Both files must exist on every executor.
    ``cached_words`` bounds the words a Python worker keeps (about 500 bytes each).
    """
    blocks = written(aligned_blocks(docs, id_col, text_col, byte_bpe, piece_model, show, block_bytes, cached_words))
    from sentencepiece import SentencePieceProcessor

    counts = pair_counts(blocks, SentencePieceProcessor(model_file=piece_model).get_piece_size())
    entry = F.struct("pos", "count", "best")
    known = (blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair")
             .groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("known")))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                def row(name: str) -> pa.Array:
                    return part.column(name)[k].values

                n_pairs = row("n_pairs").to_numpy()
                best_of, sum_of = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
                if n_pairs.any():
                    at, links = np.cumsum(_unpacked(part.column("at")[k].as_py())), _unpacked(part.column("links")[k].as_py())
                    begin = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
                    count = row("counts").to_numpy(zero_copy_only=False)[at]
                    best = row("bests").to_numpy(zero_copy_only=False)[at]
                    best_of[n_pairs > 0] = np.add.reduceat(links * best, begin)
                    sum_of[n_pairs > 0] = np.add.reduceat(links * count, begin)
                yield pa.RecordBatch.from_arrays(
                    [row("ids"), row("groups"), *(row(c) for c in COUNTS[:4]), pa.array(best_of), pa.array(sum_of)],
                    names=["_id", "groups", *COUNTS[:4], "n_best", "count_sum"])

    whole = blocks.drop("pairs", "n_docs").join(known, "block", "left")
    out = whole.select("*", F.col("known.count").alias("counts"), F.col("known.best").alias("bests")).drop("known").mapInArrow(
        batches, "_id long, groups string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long")
    return out.withColumnRenamed("_id", id_col)


def digest(groups: bytes) -> str:
    """SHA-256 of the groups; '' for no tokens."""
    return hashlib.sha256(groups).hexdigest() if groups else ""
