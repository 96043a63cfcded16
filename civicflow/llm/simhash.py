"""SimHash near duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six
of their eight positional bytes. The index therefore keys every distinct
fingerprint by the positional bytes that a partner must share: first by two of
four byte pairs (some choice of two pairs is untouched by two differing bits),
and, where such a posting list is long, by two more of the remaining bytes, so
that six bytes are fixed and a list holds at most 2**16 fingerprints. Inside a
list the shared positional bytes of a pair are tallied, pairs with fewer than
six are passed over, and the rest are verified by their bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

SEED = 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text (UTF-8) as a signed long: over half of the shingle hashes set a bit."""
    words = (text or b"").lower().split()          # bytes: lower() folds A-Z only, split() cuts at 09-0D and 20
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1:].tolist())]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):       # a very long text is unpacked in blocks
        part = np.array(hashes[k:k + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(docs: DataFrame, text_col: str, shingle: int, **keys: Column) -> DataFrame:
    """``keys`` (as longs) and the fingerprint ``fp`` of each row."""
    names = list(keys)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = [fingerprint(t.as_py(), shingle) for t in part.column("_text")]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(prints, pa.int64())], names=[*names, "fp"])

    own = docs.select(*[c.cast("long").alias(n) for n, c in keys.items()], F.col(text_col).cast("binary").alias("_text"))
    return own.mapInArrow(batches, ", ".join(f"{n} long" for n in [*names, "fp"]))


def linked_in_list(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(first of a component, other member) positions inside one posting list.

    Walks from frontier to unreached members, a block at a time, so memory stays
    in proportion to the list and no list of all pairs is made."""
    need = 8 - max_bits                            # each differing bit spoils one positional byte at most
    if len(prints) == 2:
        x = int(prints[0]) ^ int(prints[1])
        return [(0, 1)] if x.bit_count() <= max_bits else []
    out, left = [], np.arange(len(prints))
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            for k in range(0, len(frontier), 64):
                x = prints[frontier[k:k + 64], None] ^ prints[None, left]
                tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
                reached |= ((tally >= need) & (np.bitwise_count(x) <= max_bits)).any(axis=0)
            frontier, left = left[reached], left[~reached]
            out += [(int(root), int(m)) for m in frontier]
    return out


def _links(lists: DataFrame, max_bits: int) -> DataFrame:
    """lists(members: array<struct<fp, rep>>) -> links(a, b) between representatives."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = [], []
            for fps, reps in zip(part.column("fps"), part.column("reps")):
                reps = reps.values.to_numpy(zero_copy_only=False)
                prints = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for i, j in linked_in_list(prints, max_bits):
                    a.append(int(reps[i]))
                    b.append(int(reps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select(F.col("members.fp").alias("fps"), F.col("members.rep").alias("reps")).mapInArrow(
        batches, "a long, b long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(0xFF))


def _pair_keys() -> Column:
    """Six keys: each choice of two of the four byte pairs, with their bytes."""
    def value(p: int) -> Column:
        return F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(0xFFFF))

    return F.explode(F.array(*[
        F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(value(p), 16) + value(q)
        for k, (p, q) in enumerate(combinations(range(4), 2))]))


def _narrow_keys() -> Column:
    """Two more bytes beside those of a pair key: (choice, their values); which
    bytes remain follows from the pair key's choice."""
    out = F.lit(None).cast("array<long>")
    for k, pairs in enumerate(combinations(range(4), 2)):
        free = [b for b in range(8) if b // 2 not in pairs]
        keys = F.array(*[F.lit(i << 16).cast("long") + F.shiftleft(_byte(p), 8) + _byte(q)
                         for i, (p, q) in enumerate(combinations(free, 2))])
        out = F.when(F.shiftright("key", 32) == k, keys).otherwise(out)
    return F.explode(out)


def link_fingerprints(prints: DataFrame, max_bits: int = 2, long_list: int = 512) -> DataFrame:
    """``prints(fp, rep)``, one row per distinct fingerprint -> links(a, b) between
    representatives that connect exactly what the links of at most ``max_bits``
    bits connect (``max_bits`` up to 2: what the index guarantees to find)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index finds partners at 0 to 2 differing bits")
    keyed = prints.select("fp", "rep", _pair_keys().alias("key"))
    counts = written(keyed.groupBy("key").count().where("count > 1"))
    member = F.collect_list(F.struct("fp", "rep")).alias("members")
    short = keyed.join(counts.where(F.col("count") <= long_list).select("key"), "key").groupBy("key").agg(member)
    narrow = (keyed.join(counts.where(F.col("count") > long_list).select("key"), "key")
              .withColumn("more", _narrow_keys()).groupBy("key", "more").agg(member))
    lists = short.select("members").union(narrow.select("members")).where(F.size("members") > 1)
    return written(_links(lists, max_bits))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``id_col, fp, component_id`` (fingerprint as a long;
    the smallest id reachable over links of at most ``max_bits`` bits).

    Null, empty and blank texts have fingerprint zero, which links like any
    other. All distinct fingerprints are linked, also those of rows without an id, so
    that such a row connects others; ``component_id`` is null where no row of a component
    has an id. Repeated rows share a fingerprint and so a component. Other columns are
    not looked at.
    """
    own = written(_fingerprints(docs, text_col, shingle, _id=F.col(id_col)))
    prints = written(own.groupBy("fp").agg(F.min("_id").alias("least")))
    labels = connected_components(link_fingerprints(prints.select("fp", F.col("fp").alias("rep")), max_bits))
    named = written(prints.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("group")))
    # one row per component: ids of linked fingerprints meet in their smallest
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    groups = written(named.join(least, "group").select("fp", "component_id"))
    return own.join(groups, "fp", "left").select(F.col("_id").alias(id_col), "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                      shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` less near duplicates: exactly one row of each group that links of at most
    ``max_bits`` bits connect.

    All distinct fingerprints are linked, also those of rows without an id. The row
    with the smallest id stays; rows without an id come after those with one, and
    equal ids are told apart by a hash of the text, then by the row's place in
    ``docs``, which is written with its rows so that it is the same wherever it is read.
    """
    rows = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    own = written(_fingerprints(rows, f"_doc.{text_col}", shingle, _row=F.col("_row"), _id=F.col(f"_doc.{id_col}"),
                                _th=F.xxhash64(f"_doc.{text_col}")))
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("_row").alias("row"))
    first = written(own.groupBy("fp").agg(F.min(place).alias("first")))
    labels = connected_components(link_fingerprints(first.select("fp", F.col("fp").alias("rep")), max_bits))
    kept = written(first.join(labels, F.col("fp") == F.col("node"), "left")
                   .groupBy(F.coalesce("label", "fp").alias("group")).agg(F.min("first").alias("first"))
                   .select(F.col("first.row").alias("_row")))
    # the kept rows grow with the corpus: a sort-merge join at any size
    return rows.join(kept.hint("merge"), "_row", "left_semi").select("_doc.*")
