import random
import re
from collections import defaultdict

from civicflow.llm.line_dedup import drop_repeated_lines


def brute(texts, min_words):
    """{doc id: removed line numbers} by comparing the contents of all minimal windows."""
    lines = {i: [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n"))] for i, t in texts.items()}
    lines = {i: [(k, x) for k, x in ls if x] for i, ls in lines.items()}
    windows = set()
    for i, ls in lines.items():
        size = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in ls]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(size[a:b]) >= min_words:
                    windows.add((i, a, b))
                    break
            for b in range(a, -1, -1):
                if sum(size[b:a + 1]) >= min_words:
                    windows.add((i, b, a + 1))
                    break
    classes = defaultdict(list)
    for i, a, b in windows:
        classes[tuple(x for _, x in lines[i][a:b])].append((i, a, b))
    gone = defaultdict(set)
    for ws in classes.values():
        first = min(ws)
        for i, a, b in ws:
            if (i, a, b) > first and (i != first[0] or first[2] <= a):
                gone[i] |= {lines[i][k][0] for k in range(a, b)}
    return gone


def check(spark, texts, min_words):
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = brute(texts, min_words)
    for r in drop_repeated_lines(df, min_words=min_words).collect():
        assert r["removed_lines"] == sorted(want[r["doc_id"]]), r["doc_id"]
        left = "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in want[r["doc_id"]])
        assert r["text"] == left
    return want


def test_random_runs_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    texts = {}
    for i in range(40):
        part = [rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randrange(1, 25))]
        if i > 5 and rng.random() < 0.5:                     # copy a stretch of an earlier document
            src = texts[rng.randrange(i)].split("\n")
            a = rng.randrange(len(src))
            part[rng.randrange(len(part)):0] = src[a:a + rng.randrange(1, 15)]
        texts[i] = "\n".join(part)
    assert any(check(spark, texts, 9).values())
    check(spark, texts, 1)


def test_passage_run_copy_and_overlap(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    halves = "\n".join(" ".join(f"h{k}" for k in range(a, a + 30)) for a in (0, 30))
    texts = {1: f"intro\n{passage}\nend", 2: f"{passage}\nshort", 3: halves, 4: f"x\n{halves}\ny\n\nz", 5: "short\nshort",
             6: "\n".join(["again and again and again"] * 40), 7: f"x\n{halves}\ny\n\nz"}
    want = check(spark, texts, 50)
    assert want[2] == {0} and want[4] == {1, 2} and not want[1] and not want[5]
    assert len(want[6]) == 30                                # the first 50 words stay


def test_odd_rows(odd_docs):
    got = drop_repeated_lines(odd_docs, min_words=50)
    rows = got.collect()
    assert got.columns == odd_docs.columns + ["removed_lines"] and len(rows) == odd_docs.count()
    assert all(r["removed_lines"] == [] for r in rows)
    before = sorted(repr((r["doc_id"], r["text"])) for r in odd_docs.collect())
    assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == before


def test_copies_lose_everything_but_the_first(spark):
    text = "\n".join(" ".join(f"a{i}x{k}" for k in range(20)) for i in range(5))
    df = spark.createDataFrame([(9, text), (4, text), (None, text)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in drop_repeated_lines(df, min_words=50).collect()}
    assert left == {4: text, 9: "", None: ""}


def test_equal_rows_are_one_document(spark):
    """A run of five short lines is found whichever copies are repeated rows."""
    run = "\n".join(" ".join(f"r{i}x{k}" for k in range(12)) for i in range(5))
    first, second, bare = f"intro\n{run}\nend", f"other\n{run}\nlast", f"x\n{run}"
    for rows in ([(1, first)] * 2 + [(2, second)], [(1, first)] + [(2, second)] * 2, [(1, first)] * 3 + [(2, second)] * 2,
                 [(1, first)] + [(None, second)] * 3, [(None, first)] * 2 + [(2, second)]):
        got = drop_repeated_lines(spark.createDataFrame(rows + [(None, bare)] * 2, "doc_id long, text string"), min_words=50).collect()
        keeper = min(rows, key=lambda r: (r[0] is None, r[0] or 0))
        want = [(i, t if (i, t) == keeper else t.replace(run + "\n", ""), [] if (i, t) == keeper else [1, 2, 3, 4, 5]) for i, t in rows]
        want += [(None, "x", [1, 2, 3, 4, 5])] * 2
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"], r["removed_lines"])) for r in got)


def test_equal_rows_alone_keep_their_text(spark):
    text = "\n".join(" ".join(f"a{i}x{k}" for k in range(12)) for i in range(6))
    for i in (1, None):
        got = drop_repeated_lines(spark.createDataFrame([(i, text)] * 3, "doc_id long, text string"), min_words=50).collect()
        assert [(r["text"], r["removed_lines"]) for r in got] == [(text, [])] * 3


def test_empty_table(no_docs):
    assert drop_repeated_lines(no_docs).collect() == []
