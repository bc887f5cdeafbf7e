import zlib

import numpy as np
import public_tokenizers
from llm_help import SF, make_docs
from tokenizers import Tokenizer

from linkwright.llm import token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_words_as_the_library():
    texts = ["It's, a. TEST<|endoftext|>, x", "<|STARTOFTEXT|>", "don't. DON'T, 'S, a'.", "İstanbul, ΣΑΣ. é.", "\x1c\x1d a\x85b\xa0c", "é ́x", "a,.", "1, 2. 3a, ", "", "ſ, ﬁ. K", "###*** a|b", "漢字 ё"]
    coder = t.WordEncoder(PATH)
    got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([x.encode() for x in texts])]
    assert [x + [2] for x in got] == ids_of(texts)
    coder.table.most = 1
    for _ in range(2):
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode([x.encode() for x in texts])] == got


def test_capitals_of_a_text_that_is_not_lower_cased():
    texts = ["Hello <| WORLD", "hello world", "<|endoftext|> Hello heLLo It'S A b", "HELLO"]
    coder = t.WordEncoder(PATH)
    assert [np.frombuffer(x, coder.dtype).tolist() + [2] for x in coder.encode([x.encode() for x in texts])] == ids_of(texts)


def check(spark, docs, tmp, **options):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = t.write(docs, PATH, f"file://{tmp}", **options)
    got = sorted(t.read(manifest).collect(), key=lambda r: r.start)
    start = 0
    for (doc_id, _), ids, r in zip(rows, ids_of([x for _, x in rows]), got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return manifest


def test_round_trip_of_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs, tmp_path / "a", length=64, shard=5000)


def test_edge_cases_and_random_access(spark, tmp_path):
    docs = make_docs(spark, ["a b", None, "", "x" * 5000, "same", "same", (None, "no id"), (2, "again"), "w " * 20_000]).selectExpr("*", "1 AS n_tokens", "2 AS start")
    manifest = check(spark, docs, tmp_path / "b", length=16)
    for m in manifest.collect():
        s = t.Shard(m.path)
        flat = np.concatenate([s.sequence(i)[s.mask(i) == 1] for i in range(len(s))])
        assert len(flat) == m.n_tokens
        assert np.array_equal(flat, np.concatenate([ids for _, _, ids in s.documents()]))
        assert len(s) == -(-m.n_tokens // 16)
        assert all(s.reader.get_batch(k).num_rows == t.BATCH for k in range(s.reader.num_record_batches - 1))
    assert not s.sequence(0).flags.owndata and not s.mask(0).flags.owndata  # views of the file
    assert t.write_and_read(docs.limit(0), PATH).count() == 0


def test_common_words_are_spelled_once():
    spelled = []
    table = t.WordTable(lambda words: [spelled.append(w) or w for w in words], np.dtype("u1"), 20)
    for k in range(30):
        row = [b"the", b"of", *[b"rare%d-%d" % (k, i) for i in range(8)], b"the", b"of", b"once%d" % k]
        words, n = t.split([b" ".join(row), b"the"])
        idx, fresh, _ = table.look_up(words)
        assert table.sequences(idx, n) == [b"".join(row), b"the"] and len(table.index) == len(table.n) <= 20 + len(fresh)
    assert spelled.count(b"the") == spelled.count(b"of") == 1 and len(spelled) == 2 + 9 * 30


def test_words_are_cut_at_ascii_white_space():
    raw = [x.encode() for x in ["", " ", "a", "  a b\t\n\x0b\x0c\rc ", "\x1c\x1d a\x85b\xa0c　d", "\x00  ", "é  è"]]
    words, n = t.split(raw)
    assert [x.encode() for x in words.to_pylist()] == [w for x in raw for w in x.split()] and n.tolist() == [len(x.split()) for x in raw]
    assert t.split([])[0].to_pylist() == []


def test_letters_beyond_ascii_with_marks_as_the_library():
    texts = [a + b + c for a in ("é", "É", "añb", "ß", "İ", "Σ", "ſ", "漢", "é", "ΑΣ", "é1", "-é", "ǅ", "ŉ") for b in (",", ".!!", "$$$", "'", "',", "'s", "<", "<|", "’", "́", "|>", "")  for c in ("", " x")]
    coder = t.WordEncoder(PATH)
    assert [np.frombuffer(x, coder.dtype).tolist() + [2] for x in coder.encode([x.encode() for x in texts])] == ids_of(texts)
    assert [np.frombuffer(coder.encode([x.encode()])[0], coder.dtype).tolist() + [2] for x in texts] == ids_of(texts)
