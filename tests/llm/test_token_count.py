import random

import public_tokenizers
import pytest
import sentencepiece

from strandloom.llm import token_count
from strandloom.llm.token_count import count_tokens, counter, load, prove, runs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_matches_library_on_odd_texts(library):
    count = counter(MODEL, prove(MODEL)).counts
    r = random.Random(5)
    odd = ["", " ", "  ", "\n", "a  b", "   a", "b  ", "▁", "▁▁a ▁b", "<s> x </s>", "<unk>", "日本語 テ", "\r\n a", "😀 😀", "x" * 9000, "　"]
    odd += ["".join(r.choice("  ab.,\n▁<é日s>/\r\t") for _ in range(r.randint(0, 20))) for _ in range(5000)]
    want = [len(library.encode(x)) for x in odd]
    assert count(odd) == want and [n for x in odd for n in count([x])] == want


def test_whole_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in count_tokens(docs, MODEL).collect():
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)


def test_nulls_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "a b", 9), (3, "", 9)], "doc_id bigint, text string, n_tokens int")
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, MODEL).collect())
    assert rows == [(0, 3, 2), (1, 0, 0), (1, 0, 0), (3, 0, 0)]
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_the_proof_refuses_other_rules(monkeypatch):
    words = prove(MODEL)
    assert {"", "the"} <= set(words) and all(len(load(MODEL).encode(w)) == 1 for w in words if w)
    monkeypatch.setattr(token_count, "pre_tokens", lambda text: text.split())
    with pytest.raises(ValueError, match="does not split"):
        prove(MODEL)


def test_runs_and_memo(monkeypatch, library):
    texts = [None, "a", "b" * 30, "", "c d"] * 20 + ["word " * 5000, None]
    monkeypatch.setattr(token_count, "RUN_CHARACTERS", 40)
    assert [t for run in runs(texts) for t in run] == [t or "" for t in texts]
    monkeypatch.setattr(token_count, "MEMO_ENTRIES", 16_000)
    own = token_count.Counter(library, prove(MODEL))
    many = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    assert [n for t in many for n in own.counts([t, t])] == [len(library.encode(t)) for t in many for _ in range(2)]
    assert len(own) <= 16_000 + 40
