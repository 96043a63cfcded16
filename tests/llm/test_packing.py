import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from civicflow.llm.packing import Packer, WordCache, hilbert_key, pack_documents
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "\n", "  a", "a  b", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a\t b", "a \tb", "end ", "end\n", " lead", "\nlead", "don't we'll x's 's", "a,b.c, d.",
       "12 3a 4,5", "naïve façade", "Ünï ćode", "日本 語\n한국", "a b c", "x y z", "<|endoftext|> a <|endoftext|>", "a\x00b \x1c c", "$$$ !! %%%,,, ...", "ß", "a²b ½ c", "é ö",
       "word. word, word.. word,.", ". , .", "\r\nx\r\ny", "a\x85b"]


def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("most", [0, 5, 10_000])
def test_ids_by_word_are_the_tokenizers(spark, most):
    t, cache = tokenizer(), WordCache(PATH, most)
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts + ODD[::-1]:
        assert np.frombuffer(cache.ids(text), cache.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]


def test_other_tokenizers_go_whole():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t, cache = Tokenizer.from_file(path), WordCache(path)
    assert np.frombuffer(cache.ids("Some WORDS here"), cache.dtype).tolist() == t.encode("Some WORDS here", add_special_tokens=False).ids


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = hilbert_key(cells, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packer_fills_and_cuts_the_rest_into_powers_of_two():
    p = Packer(8, 0)
    for doc, n in enumerate((3, 20, 1, 6)):
        p.add(doc, np.arange(n))
    p.finish()
    lengths = {}
    for doc, start, n, crc, total, seq, at in p.done:
        assert at == lengths.get(seq, 0)
        lengths[seq] = at + n
    assert list(lengths.values()) == [8, 8, 8, 4, 2] and sum(lengths.values()) == 30


def check(rows, texts):
    """texts: list of texts per id; rows of equal ids and texts can't be told apart, so pieces are counted."""
    t, want = tokenizer(), []
    for doc, text in texts:
        want.append((doc, np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")))
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc, total), group in by_doc.items():
        same = [ids for d, ids in want if d == doc and len(ids) == total]
        assert sum(r["length"] for r in group) == total * len(same)
        for r in group:
            assert any(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in same)
        covered = sorted((r["start"], r["length"]) for r in group)
        for k in range(total):
            assert sum(a <= k < a + n for a, n in covered) == len(same) if total < 300 else True
    assert sum(len(ids) for _, ids in want) == sum(r["length"] for r in rows)
    seqs = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in seqs.values())     # no padding at all


def test_odd_rows(odd_docs):
    check(pack_documents(odd_docs, tokenizer_path=PATH).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pack_documents(docs, tokenizer_path=PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of two vocabularies fall into two stretches of the curve."""
    docs = spark.createDataFrame([(k, " ".join(("alpha beta gamma", "uno dos tres")[k % 2].split()[j % 3] for j in range(30 + k)))
                                  for k in range(40)], "doc_id long, text string")
    rows = sorted(pack_documents(docs, tokenizer_path=PATH, size=64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    kinds = [r["doc_id"] % 2 for r in rows]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 4


def test_empty_table(no_docs):
    assert pack_documents(no_docs, tokenizer_path=PATH).collect() == []


@pytest.mark.parametrize("most", [0, 10_000])
def test_added_tokens_get_their_own_ids(most):
    """The expected ids are those of the tokenizer file as it is."""
    t, cache = Tokenizer.from_file(PATH), WordCache(PATH, most)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "end<|endoftext|>", "x\n<|endoftext|>\ny <|endoftext|><|endoftext|>z", "日本 <|endoftext|> é",
             "<|endoftext", "<|endoftext |>", "<| endoftext|>", "|endoftext|>", "<|ENDOFTEXT|>"]
    for text in texts + [x for x in ODD if "<|endoftext|>" not in x] + texts[::-1]:
        assert np.frombuffer(cache.ids(text), cache.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_documents_with_added_tokens_are_packed_by_the_tokenizers_ids(spark):
    t, text = Tokenizer.from_file(PATH), "one <|endoftext|> two"
    want = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
    rows = pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path=PATH, size=2048).collect()
    assert sum(r["length"] for r in rows) == len(want) == rows[0]["doc_tokens"]
    assert all(r["ids_crc32"] == zlib.crc32(want[r["start"]:r["start"] + r["length"]].tobytes()) for r in rows)
