"""The pair occurrence index against the tokenizers library, and round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tollgate.llm import bpe
from tollgate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def ids_of(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


HARD = ["", " ", "a", "aaaa", "aaaaaaaaaaaaa", "abababababab", "  two  blanks ", "\n\n\n", "tab\tand\r\nline ",
        "it's we'll I'd they've 'S", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y <|endoftext", "1234567890 12 3",
        "ünïcödé straße ÄÖÜ ñandú", "日本語のテキスト 中文 한국어", "🙂🙃👩‍👩‍👧 emoji", "՘࢏꟎ new letters",
        "\x00\x01\x7f control", "!!!???...,,,;;;", "http://example.org/a_b?c=d&e=%20", "    wide", "é́ combining"]


def test_ids_are_the_library_s_on_hard_texts(library):
    enc = bpe.encoder()
    rng = random.Random(5)
    letters = "aabbcc eett.' \né<|0"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert got == ids_of(library, text), text
        assert enc.decode(got) == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_long_texts_are_cut_where_no_id_changes(library):
    enc = bpe.encoder()
    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "'ll", "x1", "\t ", "é", "."]) for _ in range(4000))
    for size in (1, 7, 100):
        pieces = list(enc.pieces(text, size))
        assert "".join(pieces) == text and len(pieces) > 5
        assert b"".join(enc.encode([p])[0] for p in pieces) == ids_of(library, text)
    assert list(enc.pieces("x" * 50, 10)) == ["x" * 50]


def test_chunks_of_every_latin_character(library):
    enc = bpe.encoder()
    for c in map(chr, range(0x250)):
        text = f"a{c}1{c}!{c} {c}{c} b"
        assert enc.split_latin(text) == [text[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_self_pairs_merge_from_the_left(library):
    enc = bpe.encoder()
    for n in range(1, 40):
        for c in ("a", "!", "\n", "=", "0"):
            assert enc.encode([c * n])[0] == ids_of(library, c * n), (c, n)


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    import json
    chars = list(bpe.printable_bytes())
    vocab = {c: i for i, c in enumerate([*chars, "ab", "abc"])}
    spec = {"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False},
            "model": {"type": "BPE", "vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="ranks before"):
        bpe.PairIndexEncoder(str(path))


def test_rows_nulls_repeats_and_clashing_columns(spark, make_docs, library):
    long = "the quick brown fox " * 20_000
    docs = make_docs([(1, None), (2, ""), (3, "same"), (3, "same"), (None, "null id"), (4, long)], clash=True)
    docs = docs.withColumn("ids", F.lit("other")).withColumn("decoded", F.lit("other"))
    done = bpe.decode(bpe.encode(docs))
    assert set(done.columns) == set(docs.columns) - {"text"}
    rows = sorted(((r.doc_id or 0, bytes(r.ids), r.decoded, r.row) for r in done.collect()), key=str)
    want = [(0, "null id"), (1, ""), (2, ""), (3, "same"), (3, "same"), (4, long)]
    assert rows == sorted(((i, ids_of(library, t), t, 7) for i, t in want), key=str)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query_on_the_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = ids_of(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
