import hashlib

import public_tokenizers
from llm_help import SF, make_docs
from tokenizers import Tokenizer

from linkwright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(text):
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)), ids


def test_edge_texts(spark):
    texts = ["", None, "a<|endoftext|> b  \n\t c", "aaaa aaaaaaa aaa", "it's 12 \x00\x00 x", "<|endoftext|>", "é ü 漢字 👍🏽", "x" * 20_000, "same", "same", (None, "no id")]
    docs = make_docs(spark, texts)
    got = bpe.encode_decode(docs, PATH, ids=True).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        r = by_id[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == expected(t)


def test_empty_and_extra_columns(spark):
    docs = make_docs(spark, ["a b"]).selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    assert bpe.encode_decode(docs, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_table_as_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == expected(r.text)[:3]


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    coder = bpe.PairIndexBPE(PATH)
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    for text in ("one two three", "four five one", "six"):
        words = coder.pieces(text)
        coder.learn(set(words))
        assert [int(i) for w in words for i in coder.ids[w].split(',')] == expected(text)[3]
