import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from civicflow.llm import queries
from civicflow.llm.align import Block, TwoTokenizers, align_documents, digest, shared_cuts
from civicflow.llm.packing import ranked_encoder
from tokenizers import Tokenizer

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", None, "a", " a", "a  b", "\n", "\na", "a\n", "a\n\nb", "a\n\n\nb", "x\ty", "日本語 テキスト\nだ", "emoji 😀😀 x", "▁ a", "a▁b",
       "<s> </s> <unk> <0x0A> <|endoftext|> x", "é ö ñandú ﬁ ＡＢ", "\x00", "a\x00b \x1c c", " " * 100 + "x", "a" * 3000, "\u200b x",
       "don't we'll 12,000.50 $$$", "a \n b", "\r\n a", "a\x85b\xa0c", "  ", "a ", "日" * 700, "l'été c'est-à-dire", " \n" * 300]


@pytest.fixture(scope="module")
def two():
    return TwoTokenizers(A, B, 500)


def brute(two, text):
    """(ids of A, ids of B, groups) by cutting at every offset where both end."""
    if not text:
        return None
    a = two.a.encode(" " + text, add_special_tokens=False).ids
    b = two.b.encode(text)
    spelled = b"".join(two.bytes_a[i] for i in a)
    if spelled != (" " + text).encode() or spelled != b"".join(two.bytes_b[i] for i in b):
        return None
    ends_a, ends_b = np.cumsum([len(two.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(two.bytes_b[i]) for i in b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        ni, nj = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    return a, b, groups


def spelled(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(two, rows):
    """What align_documents returns for (id, text) rows, by brute force."""
    all_links, out = [], []
    for _, text in rows:
        found = brute(two, text)
        all_links.append(Counter((x, y) for xs, ys in (found[2] if found else []) for x in xs for y in ys))
    count = Counter(pair for links in all_links for pair in links)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for (i, text), links in zip(rows, all_links):
        a, b, groups = brute(two, text) or ([], [], [])
        out.append((i, spelled(groups), len(a), len(b), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items())))
    return out


COLUMNS = ["doc_id", "groups", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def key(row):
    return tuple((x is None, x) for x in row)


def test_blocks_are_the_brute_groups(two):
    for _ in range(2):                                # words known and new
        block = Block(two, ODD)
        for k, (text, groups) in enumerate(zip(ODD, block.groups())):
            a, b, want = brute(two, text) or ([], [], [])
            assert groups.decode() == spelled(want), text
            assert (block.n_a[k], block.n_b[k], block.n_groups[k]) == (len(a), len(b), len(want))


def test_cuts_are_all_common_ends():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 2000):
        ends_a = np.unique(np.append(rng.choice(3 * n, n), 3 * n))
        ends_b = np.unique(np.append(rng.choice(3 * n, max(1, n // 5)), 3 * n))
        one = np.array([0])
        cut_a, cut_b = shared_cuts(ends_a, ends_b, one, np.array([len(ends_a)]), one, np.array([len(ends_b)]))
        assert ends_a[cut_a].tolist() == ends_b[cut_b].tolist() == np.intersect1d(ends_a, ends_b).tolist()


def test_whole_result_is_brute_force(spark, two):
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, " a"), (3, " a"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, block string, at int, pairs int")
    got = align_documents(docs.repartition(3), byte_bpe=A, piece_model=B, block_bytes=5000, cached_words=100)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(two, rows), key=key)


def test_odd_tables(spark, odd_docs, no_docs, two):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["text"] is None or len(r["text"]) < 5000]
    got = align_documents(odd_docs.where("text IS NULL OR length(text) < 5000"), byte_bpe=A, piece_model=B)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(two, rows), key=key)
    assert align_documents(no_docs, byte_bpe=A, piece_model=B).collect() == []
    long = align_documents(odd_docs.where("length(text) > 5000"), byte_bpe=A, piece_model=B).collect()
    assert len(long) == 2 and all(r["n_groups"] > 40_000 for r in long)


def test_registered_query(spark, two):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(r[0], hashlib.sha256(r[1].encode()).hexdigest() if r[1] else "", *r[2:]) for r in expected(two, rows)]
    got = queries.QUERIES["op11_align_tokenizers"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert digest(b"") == ""


def test_ranks_give_the_ids_of_the_file():
    t, fast = Tokenizer.from_file(A), ranked_encoder(A)
    t.encode_special_tokens = True
    letters = [chr(c) for c in range(0x250)]
    for x in letters:
        for text in (x, f"a{x}b", f"a{x}{x} 1{x}", f" {x}'s", f"{x} \n{x}"):
            assert fast(text) == t.encode(text, add_special_tokens=False).ids, ascii(text)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(letters, 12))
        assert fast(text) == t.encode(text, add_special_tokens=False).ids, ascii(text)
    assert ranked_encoder(str(public_tokenizers.path("word_bpe_49k.json"))) is None
