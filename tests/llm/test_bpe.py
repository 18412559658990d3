import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymill.llm import bpe
from waymill.llm.textplane import Plane

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)

PIECES = ["a", "b", "the", " the", "ing", "e", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'v", "s", "t", "é", "e\u0301", "ß", "1", "22", "½", "²", "\u00a0", "\u2003", "\u200b", "\x1c", "!", "...", "-", "漢字", "🙂", "👩‍👩‍👧", "<|endoftext|>", "\\", "_", "İ"]


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


@pytest.fixture(scope="module")
def reference():
    tokenizer = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def encoded(encoder, texts):
    ids, at = encoder.encode(Plane(texts))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_equals_the_library_on_pieces(encoder, reference, texts):
    assert encoded(encoder, texts) == [reference(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=40), max_size=4))
def test_equals_the_library_on_any_text(encoder, reference, texts):
    assert encoded(encoder, texts) == [reference(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdetihng", min_size=1, max_size=3).flatmap(lambda s: st.integers(1, 2000).map(lambda n: (s * n)[:3000])), st.integers(1, 700))
def test_streaming_equals_whole(encoder, reference, text, step):
    transducer, out = bpe.Transducer(encoder.merges), []
    data = text.encode()
    for k in range(0, len(data), step):
        out += transducer.feed(data[k : k + step])
        assert len(transducer.held) <= 2 * (encoder.merges.lookahead + encoder.merges.longest)
    assert out + transducer.finish() == reference(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=200).map("".join), st.integers(8, 60))
def test_windows_of_a_long_text(encoder, reference, text, window):
    assert encoder.encode_long(text, window).tolist() == reference(text)


def test_decoder_handles_characters_across_tokens(encoder, reference):
    text = "🙂 漢字 é \ufffd " * 20
    ids = reference(text)
    decoder = bpe.Decoder(encoder.merges)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == text
    broken = bpe.Decoder(encoder.merges)
    assert broken.feed(reference("漢")[:1]) + broken.finish() == "\ufffd"


def test_column(spark, reference):
    long = "x" * 5000 + " and " + "long text " * 3000
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "a"), (1, "hello world"), (5, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "2 AS key")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe.encode_column(df, window=2000).collect())
    assert got == sorted((str(i), reference(t or "")) for i, t in rows)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(bpe.encode_column(df)).collect()}
    assert back[5] == long and back[3] == "" and back[1] == "hello world"
    assert bpe.encode_column(df.limit(0)).collect() == []
    assert bpe.decode_column(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")).orderBy("doc_id").collect()[0]["text"] is None


def test_memory_is_renewed(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    texts = [f"word{k} other{k}" for k in range(50)]
    assert [encoded(encoder, [t])[0] for t in texts] == [reference(t) for t in texts]


def test_lookahead_is_sufficient_but_bounded(encoder):
    assert encoder.merges.longest <= encoder.merges.lookahead < 1000
