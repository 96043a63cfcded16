import random
import re

import numpy as np
import xxhash
from civicflow.llm.simhash import fingerprint, linked_in_list, simhash_groups, link_fingerprints
from civicflow.llm.components import connected_components
from pyspark.sql import functions as F


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """pairs: {id: fingerprint} -> {id: smallest reachable id}"""
    ids = sorted(pairs)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (pairs[i] ^ pairs[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_groups_on_odd_rows(odd_docs):
    rows = [r for r in odd_docs.collect()]
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"] for r in simhash_groups(odd_docs).collect()}
    assert len(simhash_groups(odd_docs).collect()) == len(rows)
    prints = {}
    for r in rows:
        fp = plain_fingerprint(r["text"])
        assert (r["doc_id"], fp) in got
        if r["doc_id"] is not None:
            prints[r["doc_id"]] = fp
    want = brute_components(prints)
    assert {k[0]: v for k, v in got.items() if k[0] is not None} == want


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_links_equal_brute_force_with_long_lists(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for base in rng.sample(sorted(prints), 20):            # chains and clouds of near ones
        at = base
        for _ in range(6):
            at = near(rng, at, rng.choice((1, 2, 3)))
            prints.add(at)
    cloud = rng.getrandbits(64)
    prints |= {near(rng, cloud, k) for k in (1, 2, 2, 2, 2) for _ in range(40)}
    own = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), k) for k, v in own.items()], "fp long, rep long")
    for long_list in (1, 8, 512):                          # 1: every list goes through the narrow keys
        labels = {r["node"]: r["label"] for r in connected_components(link_fingerprints(df, 2, long_list)).collect()}
        assert {k: labels.get(k, k) for k in own} == brute_components(own)


def test_list_is_walked_whole():
    prints = np.array([0, 1, 3, 7, 15, 0xFF << 40], np.uint64)     # a chain, and one apart
    assert {j for _, j in linked_in_list(prints, 1)} == {1, 2, 3, 4}


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 8), (8, 9), (9, 7), (4, 4)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in range(200, 260))
    assert got[9] == 7 and 4 not in got


def test_empty_table(no_docs):
    assert simhash_groups(no_docs).collect() == []


def test_very_long_text_is_hashed_whole():
    text = " ".join(f"w{k}" for k in range(70_000))
    assert fingerprint(text.encode(), 3) & (1 << 64) - 1 == plain_fingerprint(text)


def test_rows_without_an_id_connect_others(spark):
    """Documents 7 and 9 are too far apart, a row without an id is near both; another such row is near 7 alone."""
    rng = random.Random(4)

    def bits(x, y):
        a, b = (fingerprint(t.encode(), 3) & (1 << 64) - 1 for t in (x, y))
        return (a ^ b).bit_count()

    chain = []
    while len(chain) < 3:                              # two steps of one or two bits that lead out of reach of the start
        start = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
        near = [t for t in (f"{start} x{k}" for k in range(40)) if 1 <= bits(start, t) <= 2]
        chain = next(([x, start, y] for x in near for y in near if bits(x, y) > 2), [])
    far = "nothing like the others at all in any way"
    docs = spark.createDataFrame([(7, chain[0]), (None, chain[1]), (9, chain[2]), (None, far), (None, far)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_groups(docs).collect()), key=repr)
    assert got == sorted([(7, 7), (None, 7), (9, 7), (None, None), (None, None)], key=repr)
