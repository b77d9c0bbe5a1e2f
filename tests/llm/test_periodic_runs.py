"""Runs against a brute-force search."""

import hashlib
import random
import re
import zlib

import pytest

from seapoint.llm.periodic_runs import document_runs, find_runs, run_digests


def _brute(x, least=12):
    """Every lag from every place: (start, length, smallest period)."""
    best = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def _words_like(rng):
    kind, n = rng.randint(0, 5), rng.randint(20, 350)
    if kind == 0:
        return [rng.randrange(rng.randint(1, 4)) for _ in range(n)]
    if kind == 1:
        x = [rng.randrange(3) for _ in range(rng.randint(1, 60))] * rng.randint(2, 8)
        if rng.random() < 0.5:
            x[rng.randrange(len(x))] = 9
        return x[:500]
    if kind == 2:  # nested repeats
        out, unit = [], [rng.randrange(2) for _ in range(rng.randint(1, 5))]
        while len(out) < n:
            out += (unit * 40)[: rng.randint(8, 80)] + [rng.randrange(3)] * rng.randint(0, 1)
            out *= rng.choice((1, 1, 2))
        return out[:500]
    if kind == 3:  # Fibonacci words have many runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:  # one run goes over into another of the same period
        unit = [0, 1, 1][: rng.randint(2, 3)]
        return (unit * rng.randint(5, 90) + unit[::-1] * rng.randint(5, 90) + unit * rng.randint(0, 60))[:500]
    blocks, out = [[rng.randrange(50) for _ in range(rng.randint(1, 50))] for _ in range(3)], []
    while len(out) < n:
        out += rng.choice(blocks) * rng.randint(1, 3)
    return out[:500]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs(seed):
    rng, total = random.Random(seed), 0
    for _ in range(25):
        texts = [_words_like(rng) for _ in range(rng.randint(1, 12))]
        text, start, length, period = find_runs([[b"w%d" % v for v in x] for x in texts])
        got = [[] for _ in texts]
        for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
            got[t].append(tuple(run))
        want = [_brute(x) for x in texts]
        assert got == want
        total += sum(map(len, want))
    assert total > 1000


def test_long_and_uniform_texts_are_not_square():
    text, start, length, period = find_runs([[b"a"] * 300_000, [b"a", b"b"] * 50_000 + [b"b", b"a"] * 50_000, [], [b"x"]])
    assert (text[0], start[0], length[0], period[0]) == (0, 0, 300_000, 1)
    assert set(text.tolist()) == {0, 1} and len(text) > 10_000


def _expected(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = _brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *longest, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_tables(spark, corpus, nothing):
    rng = random.Random(4)
    more = [(1000 + i, " ".join(f"w{v}" for v in _words_like(rng)), None, None, None, "x", "y") for i in range(120)]
    more += [(5000, "la " * 700, None, None, None, "x", "y"), (5000, "la\n" * 700, None, None, None, "x", "y"), (5001, " ".join("ab" * 20), None, None, None, "x", "y")]
    docs = corpus.filter("length(text) < 5000 OR text IS NULL").unionByName(spark.createDataFrame(more, corpus.schema))
    want = [_expected(r.doc_id, r.text) for r in docs.collect()]
    got = run_digests(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 60 and any(zlib.crc32(str(w[0]).encode()) % 10 == 0 for w in want)
    assert run_digests(nothing).collect() == [] and document_runs(nothing).collect() == []
    assert document_runs(docs.filter("doc_id = 5000")).distinct().collect() == [(5000, 0, 700, 1)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in run_digests(docs).collect()}
    given = docs.collect()
    assert len(rows) == len(given)
    for r in given:
        if len((r.text or "").split()) < 400:
            assert rows[r.doc_id] == _expected(r.doc_id, r.text)
