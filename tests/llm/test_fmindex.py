import random
import re

import numpy as np
import pytest

from waymill.llm import fmindex

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text, markup):
    text = text.lower()
    if markup:
        text = re.sub(r"\\[^\W\d_]+", " ", text.replace("\\-", ""))
    return re.findall(r"[^\W_]+", text)


def brute(docs, items, n=12):
    out = set()
    for i, a in docs:
        w = words(a or "", True)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for j, b in items:
            v = words(b or "", False)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((i, j))
    return out


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "'x' AS begin", "2 AS words")
    return fmindex.leaked_spans(d, spark.createDataFrame(items, ITEMS), **options)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 500)
    index = fmindex.FMIndex(text, 4, sample=5)
    phrases = np.array([text[k : k + 4] for k in rng.integers(0, 490, 60)] + [rng.integers(0, 4, 4) for _ in range(20)])
    begin, end = index.search(phrases)
    for p, a, b in zip(phrases, begin, end):
        want = [k for k in range(497) if (text[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(20):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        assert fmindex.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


def indexed(spark, docs, items, *, shard_words=500_000, **options):
    index = fmindex.stored_index(spark.createDataFrame(docs, "doc_id bigint, text string"), shard_words=shard_words)
    return fmindex.indexed_spans(index, spark.createDataFrame(items, "item_id bigint, text string"), **options)


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_chars": 200}])
def test_against_brute_force(spark, options):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["Straße", "été", "русский", "2024"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(25)] + [(90, None), (91, ""), (92, "too short")]
    items.append((93, items[0][1]))
    docs = []
    for k in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 2:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 6)
            part = source[a : a + rng.randint(9, 30)]
            own[len(own) // 2 : len(own) // 2] = part
        text = " ".join(w.upper() if rng.random() < 0.3 else w[:2] + "\\-" + w[2:] if rng.random() < 0.1 else "\\emph{" + w + "}" if rng.random() < 0.1 else w for w in own)
        docs.append((k, text))
    docs += [(500, None), (501, ""), (502, "\\-"), (503, "\\"), (504, "\\foo"), (505, docs[1][1])]
    rows = found(spark, docs, items, **options).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items)
    assert sorted(map(tuple, indexed(spark, docs, items, **options).collect())) == sorted(map(tuple, rows))
    text = dict(docs)
    for r in rows:
        span = words(text[r["doc_id"]][r["begin"] : r["end"]], True)
        assert len(span) == r["words"] >= 12


def test_spans_merge_and_count_characters(spark):
    item = " ".join(f"word{k}" for k in range(30))
    doc = "Intro, \\textbf{bold}. " + item.replace("word5 ", "wo\\-rd5, ").upper() + " outro"
    got = found(spark, [(1, doc)], [(7, item)]).collect()
    assert [(r["item_id"], r["words"]) for r in got] == [(7, 30)]
    assert doc[got[0]["begin"] : got[0]["end"]] == doc[doc.index("WORD0") : doc.index(" outro")]


def test_borders(spark):
    item = " ".join(f"a{k}" for k in range(12))
    half, rest = item[: len(item) // 2], item[len(item) // 2 :]
    docs = [(1, item), (2, half), (3, rest), (4, item.replace("a5 ", "a5 x ")), (5, item.replace(" ", "\\quad ")), (6, item.replace("a5", "\\a5")), (7, "z " * 100_000 + item)]
    assert {r["doc_id"] for r in found(spark, docs, [(1, item)]).collect()} == {1, 5, 7}
    assert sorted(map(tuple, indexed(spark, docs, [(1, item)], shard_words=20).collect())) == sorted(map(tuple, found(spark, docs, [(1, item)]).collect()))


def test_a_stored_index_serves_other_items(spark, tmp_path):
    docs = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(40))) for k in range(20)] + [(50, None), (51, "!")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS keys", "2 AS length")
    fmindex.stored_index(frame, shard_words=100).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 3
    for items in ([(1, docs[3][1])], [(2, docs[9][1].upper()), (3, "none of these words is in any of the texts of this corpus at all")]):
        got = fmindex.indexed_spans(index, spark.createDataFrame(items, "item_id bigint, text string")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, found(spark, docs, items).collect())) and got


def test_empty_tables(spark):
    assert indexed(spark, [], [(1, "x " * 20)]).collect() == [] and indexed(spark, [(1, "x " * 20), (2, "")], []).collect() == []
    assert fmindex.stored_index(spark.createDataFrame([(1, "?!"), (2, None)], "doc_id bigint, text string")).collect() == []
    assert found(spark, [], [(1, "x " * 20)]).collect() == [] and found(spark, [(1, "x " * 20)], []).collect() == []
    assert found(spark, [(1, "x " * 20)], [(None, "x " * 20)]).select("item_id").collect()[0][0] is None
