"""Byte-level BPE against the library of the rank files, and decoding against Python's own."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from seapoint.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def content():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(content):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(content), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_is_the_library_s(name):
    with open(P.path(name), "rb") as f:
        ranks = f.read()
    own = bpe.Encoder(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    rng = random.Random(3)
    for letters in ("etaoin shr", "ab \n\t\r'sé日aein  ́😀1.\x1c\x85", "aaaa ", "\U0001f468‍ñ́x "):
        for _ in range(1500):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
            assert own.encode(text) == library.encode_ordinary(text), repr(text)
    for text in ("a" * 3000, "the" * 900, " " * 500, "x \n" * 400, "<|endoftext|>", "0123456789" * 50):
        assert own.encode(text) == library.encode_ordinary(text)


def test_merges_whose_ranks_fall():
    """A merge that is due before its parts: edges do not grow in the order of ranks, and the merges themselves decide."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"cab": 259}
    machine, rng = bpe.Transducer(ranks), random.Random(1)
    assert machine._edges(256) is None
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert machine.encode(text.encode()) == library.encode_ordinary(text), text


def test_windows_do_not_change_the_tokens(library, content):
    rng = random.Random(9)
    own = bpe.Encoder(content, P.PATTERN)
    text = "".join(rng.choice(["word", " ", "  ", "\n", " \n ", "it's", "日本", "7", "\t", " x"]) for _ in range(3000))
    parts = list(bpe.windows(text, 50))
    assert len(parts) > 50 and "".join(parts) == text
    assert [t for part in parts for t in own.encode(part)] == library.encode_ordinary(text)
    assert list(bpe.windows("x" * 500, 50)) == ["x" * 500]


def test_utf8_machine_is_python_s():
    rng = random.Random(2)
    some = [0x00, 0x41, 0x7F, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(20000):
        data = bytes(rng.choice(some) for _ in range(rng.randint(0, 7)))
        out, pending = [], b""
        for byte in data:
            text, pending = bpe.utf8_step(pending, byte)
            out.append(text)
        assert "".join(out) + ("�" if pending else "") == data.decode("utf-8", "replace"), data


def test_streaming_decode(content, library):
    decoder = bpe.Decoder(content)
    text = "naïve 日本語 😀 ok"
    got = [decoder.feed([t]) for t in library.encode_ordinary(text)]
    assert "".join(got) == text and "" in got and decoder.close() == ""
    assert decoder.feed(library.encode_ordinary("😀")[:1]) == "" and decoder.close() == "�"
    with pytest.raises(ValueError, match="no token has the id 99999999"):
        decoder.feed([99999999])


def test_tables(spark, corpus, nothing, library):
    odd = spark.createDataFrame([(900, "a  b\n\n c <|endoftext|> é日😀\x00", None, None, None, "x", "y"), (901, "\n".join(["long"] * 300_000), None, None, None, "x", "y")], corpus.schema)
    docs = corpus.unionByName(odd)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(r.text or "")))
    got = bpe.token_digests(docs, PATH, P.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.token_digests(nothing, PATH, P.PATTERN).collect() == []
    # Round trip by tables; a column that is called as the new one is replaced, the others stay.
    clash = docs.selectExpr("*", "1 AS tokens")
    coded = bpe.encode_texts(clash, PATH, P.PATTERN)
    assert coded.columns == [*docs.columns, "tokens"]
    back = bpe.decode_tokens(coded.withColumnRenamed("text", "was"), PATH)
    rows = back.collect()
    assert len(rows) == len(want) and all(r.text == r.was for r in rows)
    assert sum(r.text is None for r in rows) == 1
