"""Alignment against both libraries on whole texts, counts against a plain counter."""

import hashlib
import random
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seapoint.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _expected(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    chars = T.byte_level_bytes()
    spell = {i: bytes(chars[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items()}
    aligned, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text, num_threads=1)
        a_bytes = [spell[t] for t in a]
        b_bytes = [bytes([int(second.id_to_piece(t)[1:-1], 16)]) if second.is_byte(t) else second.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            aligned.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = list(np.cumsum([len(x) for x in a_bytes])), list(np.cumsum([len(x) for x in b_bytes]))
        at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = at_a[cut] + 1, at_b[cut] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links = [(a[at_a[c]], b[at_b[c]]) for c in cuts]
        counts.update(links)
        aligned.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, second_id), n in counts.items():
        best[second_id] = max(best[second_id], n)
    return [
        (doc, len(a), len(b), len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for doc, a, b, links, digest in aligned
    ]


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


ODD = [
    "a  b", " lead", "trail ", "two  ", " ", "  ", "\n", "line\n next\n\n  indented\tx", "ﬁ é é x", "a▁b c", "<s> x </s> <|endoftext|>", "你　好 世界", "😀 x\x00y",
    "it's 12,345.67!!", "x" * 700, "non breaking space z", "\x1c \x85 q", "naïve café", "a\r\nb", "ab " * 400,
]


@pytest.mark.parametrize("most_shared", [T.MOST_SHARED, 0])
def test_tables(spark, corpus, nothing, most_shared, monkeypatch):
    """Both ways to look counts up, with many buckets and a tree of several levels."""
    monkeypatch.setattr(T, "BUCKET_PAIRS", 50)
    monkeypatch.setattr(T, "FAN", 2)
    rng = random.Random(5)
    letters = ["the", " ", "  ", "\n", "tion", ",", "é", "日本", "'s", " x", "\t", "7", ".", " "]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    odd = spark.createDataFrame([(2000 + i // 2, t, None, None, None, "x", "y") for i, t in enumerate(texts)], corpus.schema)
    docs = corpus.unionByName(odd).repartition(7)
    got = T.align_tokens(docs, A, B, most_shared)
    want = _expected([(r.doc_id, r.text) for r in docs.collect()])
    assert _sorted(got.collect()) == _sorted(want)
    assert sum(w[1] == 0 for w in want) == 3 and sum(w[1] > 0 for w in want) > 150
    assert T.align_tokens(nothing, A, B, most_shared).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        for hashed in (T.PerfectHash(keys), T.PerfectHash.load(T.PerfectHash(keys).dump())):
            assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    table = T.PairTable(T.PerfectHash(keys).dump(), keys[np.argsort(T.PerfectHash(keys)(keys))].tobytes())
    others = keys + np.uint64(1)
    assert (table.numbers(others[~np.isin(others, keys)]) == -1).all()
    with pytest.raises(LookupError):
        table.all_numbers(others)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _expected([(r.doc_id, r.text) for r in docs.collect()])
    assert _sorted(T.align_tokens(docs, A, B).collect()) == _sorted(want)


def test_chunks_are_forgotten(spark, corpus, monkeypatch):
    """A small memory for chunks changes nothing."""
    monkeypatch.setattr(T, "MOST_CHUNKS", 40)
    assert _sorted(T.align_tokens(corpus, A, B).collect()) == _sorted(_expected([(r.doc_id, r.text) for r in corpus.collect()]))


def test_texts_are_aligned_once(corpus, monkeypatch):
    """The second pass needs the links that the first one wrote down and no text, a few rows or many at a time."""
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    seen, numbers = [], T.Aligner.numbers
    monkeypatch.setattr(T.Aligner, "numbers", lambda self, texts: seen.extend(texts) or numbers(self, texts))
    monkeypatch.setattr(T, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    holders = [SimpleNamespace(value={"file": Path(p).read_bytes()}) for p in (A, B)]
    batch = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}).to_batches()
    first = pa.Table.from_batches(T._first_pass(holders, iter(batch)))
    kept, counted = first.filter(pc.is_valid(first["links"])), first.filter(pc.is_valid(first["pair"]))
    assert kept.num_rows + counted.num_rows == first.num_rows and set(counted["task"].to_pylist()) == {3}
    pairs, n = counted["pair"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    links = np.concatenate([T._unpacked(x) for x in kept["links"].to_pylist()])
    assert dict(zip(pairs.tolist(), n.tolist())) == Counter(links.tolist())
    hashed = T.PerfectHash(pairs)
    keys, sums = np.empty(len(pairs), np.uint64), np.empty(len(pairs), np.int64)
    keys[hashed(pairs)], sums[hashed(pairs)] = pairs, n
    best = np.zeros(1 << 16, np.int64)
    np.maximum.at(best, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), n)
    for most in (T.SLICE_LINKS, 300, 1):
        monkeypatch.setattr(T, "SLICE_LINKS", most)
        lookup = SimpleNamespace(value={"rows": [(0, hashed.dump(), keys.tobytes(), sums.tobytes())], "buckets": 1, "best": best})
        out = pa.Table.from_batches(T._looked_up(lookup, iter(kept.combine_chunks().to_batches())))
        got = zip(*(out[c].to_pylist() for c in ("doc_id", *T.COUNTS, "n_best", "count_sum", "groups_sha256")))
        assert _sorted(got) == _sorted(_expected(rows))
    assert len(seen) == len(rows)
