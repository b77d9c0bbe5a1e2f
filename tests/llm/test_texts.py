"""Word operators against plain Python over whole small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from seapoint.llm import lm_scoring, shingle_join
from seapoint.llm.decontamination import benchmark_hits, without_contaminated
from seapoint.llm.lm_scoring import score_documents
from seapoint.llm.shingle_join import link_documents, one_of_each
from seapoint.llm.staging import staged
from seapoint.llm.substring_dedup import COVER, PERIOD, remove_repeats
from seapoint.llm.words import Words


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _fold(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_remove_repeats(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    first = {}
    for doc, text in rows:
        words = _words(text)
        for a in range(len(words) - 49):
            if doc is not None:
                key = tuple(words[a : a + 50])
                first[key] = min(first.get(key, doc), doc)
    want = []
    for doc, text in rows:
        words = _words(text)
        gone = set()
        for a in range(len(words) - 49):
            if doc is not None and first[tuple(words[a : a + 50])] < doc:
                gone.update(range(a, a + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert any(n for _, _, n, _ in want)
    assert _sorted(remove_repeats(corpus).collect()) == _sorted(want)
    assert remove_repeats(nothing).collect() == []


def test_benchmark_hits(spark, corpus, nothing):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    items = [(1, " ".join(_words(texts[8])[12:40])), (10, " ".join(_words(texts[8])[12:40])), (2, "ONE, two"), (3, None), (4, ""), (5, "no such words here at all"), (None, texts[9])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _fold(t))
    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        for a in range(len(w) - 9) if len(w) >= 10 else ([0] if w else []):
            known[tuple(w[a : a + min(10, len(w))])].add(item)
    want = []
    for r in corpus.collect():
        w, hit, found = words(r.text), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in known:
                    hit.update(range(a, a + n))
                    found |= known[tuple(w[a : a + n])] - {None}
        want.append((r.doc_id, len(w), len(hit), ",".join(sorted(map(str, found)))))
    assert sum(n > 0 for _, _, n, _ in want) > 10
    got = benchmark_hits(corpus, benchmark).withColumn("items", F.array_join("items", ",")).drop("spans")
    assert _sorted(got.collect()) == _sorted(want)
    assert benchmark_hits(corpus, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert benchmark_hits(nothing, benchmark).collect() == []
    clean = without_contaminated(corpus, benchmark)
    assert clean.columns == corpus.columns
    assert _sorted(r.doc_id for r in clean.select(F.struct("doc_id").alias("doc_id")).collect()) == _sorted(
        (d,) for d, _, n, _ in want if not n
    )


def _linked(rows):
    sets = defaultdict(list)
    for doc, text in rows:
        w = _words(_fold(text))
        sets[doc].append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x & y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, root


def test_link_documents(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    sets, root = _linked(rows)
    want = []
    for doc, text in rows:
        w = _words(_fold(text))
        n = len({tuple(w[a : a + 5]) for a in range(len(w) - 4)}) or int(bool(w))
        want.append((doc, n, None if doc is None else root(doc)))
    assert any(d != c for d, _, c in want)
    assert _sorted(link_documents(corpus).collect()) == _sorted(want)
    assert link_documents(nothing).collect() == []
    kept = one_of_each(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({c for _, _, c in want if c is not None})
    # The row without an id is a copy of another one.
    assert kept.filter("doc_id IS NULL").count() == 0


def test_links_of_repeated_ids(spark, corpus):
    """An id with several texts links through each of them; near misses don't; exactly 75 % does; clashing columns don't matter."""
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    t1, t2, template = say(80), say(80), say(120)
    rows = [(1, " ".join(t1)), (2, " ".join(t1)), (2, " ".join(t2)), (3, " ".join(t2[:78] + ["x", "y"])), (2, None)]
    # 96 and 72 shingles, 72 shared: exactly 75 %; with 71 it is less.
    exact = say(100)
    rows += [(10, " ".join(exact)), (11, " ".join(exact[:76])), (12, " ".join(exact[:75]))]
    rows += [(20 + i, " ".join(w if k % 17 or rng.random() < 0.3 else f"n{i}" for k, w in enumerate(template))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], corpus.schema)
    _, root = _linked(rows)
    got = {(r.doc_id, r.component_id) for r in link_documents(docs).collect()}
    assert got == {(i, root(i)) for i, _ in rows}
    assert root(3) == 1 and root(11) == 10 and root(12) == 10 and len({root(20 + i) for i in range(40)}) > 3
    clash = docs.withColumn("gone_id", F.lit(1)).withColumn("again_id", F.lit(2))
    kept = one_of_each(clash)
    # Rows are judged by their texts: of document 2 the text that document 3 nearly copies stays, and the row without one.
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == clash.columns and set(ids) == {root(i) for i, _ in rows} | {2} and ids.count(2) == 2


def test_pairs_are_verified_in_slices_of_bytes(monkeypatch):
    """However long the texts of many pairs are, only a few of them are unpacked at once."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(20_000)).encode() for _ in range(4)]
    pairs = [(rng.randrange(4), rng.randrange(4)) for _ in range(100)]
    packed = [zstandard.ZstdCompressor().compress(t) for t in texts]
    columns = [pa.array(range(100)), pa.array(range(100, 200)), *(pa.array([packed[p[i]] for p in pairs], pa.binary()) for i in (0, 1))]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "pa", "pb"])
    seen, sets = [], shingle_join.shingle_sets
    monkeypatch.setattr(shingle_join, "shingle_sets", lambda texts: seen.append(sum(map(len, texts))) or sets(texts))
    found = [a for x in shingle_join._verify(iter([batch, batch.slice(0, 0)])) for a in x.column(0).to_pylist()]
    assert found == [i for i, (x, y) in enumerate(pairs) if x == y]
    assert max(seen) <= shingle_join.SLICE_BYTES and len(seen) > 2
    monkeypatch.setattr(shingle_join, "SLICE_BYTES", 1)
    assert sum(x.num_rows for x in shingle_join._verify(iter([batch]))) == len(found)


def test_large_sets_are_screened(spark):
    """A sketch that grows with the sets rejects large ones that have little in common, and no pair that links."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 12_000, dtype=np.uint64)
    sets = [pool[:4000], pool[500:4500], pool[500:3700], pool[4500:8500], pool[8000:12_000], pool[:60], pool[2:62], pool[:0]]
    n = np.array([len(x) for x in sets])
    dense, wide = shingle_join._sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    rows = list(zip(range(len(sets)), n.tolist(), dense.to_pylist(), wide.to_pylist()))
    facts = spark.createDataFrame(rows, "doc long, n long, dense array<long>, wide array<long>")
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if n[b] and n[a] and 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b])]
    got = {tuple(r) for r in shingle_join._screened(spark.createDataFrame(pairs, "a long, b long"), facts).collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (6, 5)}


def test_many_near_misses_are_not_all_compared(spark, monkeypatch):
    """Of a large group about as similar as the limit, and one that shares a line only, few pairs are verified; no link is lost."""
    rng = random.Random(2)
    say = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    template, line = say(200), say(30)
    texts = [[w if rng.random() > 0.035 else f"n{rng.randrange(9000)}" for w in template] for _ in range(120)]
    texts += [line + say(rng.randint(9, 14)) for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    compared, similar = [], shingle_join._similar
    monkeypatch.setattr(shingle_join, "_similar", lambda pairs, texts: compared.append(pairs.count()) or similar(pairs, texts))
    _, root = _linked(rows)
    got = {(r.doc_id, r.component_id) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, root(i)) for i, _ in rows}
    assert 1 < len({root(i) for i in range(120)}) < 100 and len({root(i) for i in range(120, 240)}) > 100
    assert sum(compared) < 100


def test_a_pair_comes_once_for_many_shared_positions(spark, monkeypatch):
    """The join of the positions makes about one row for each pair of near misses, however much they share."""
    rng = random.Random(4)
    template = [f"v{rng.randrange(900)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"n{rng.randrange(9000)}" for w in template)) for i in range(80)]
    made, last_pairs = [], shingle_join._last_pairs

    def counted(rest):
        pairs = last_pairs(rest)
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(shingle_join, "_last_pairs", counted)
    _, root = _linked(rows)
    got = {(r.doc_id, r.component_id) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, root(i)) for i, _ in rows}
    [(joined, pairs)] = made
    assert pairs > 100 and joined < 1.2 * pairs


def test_variants_of_one_text_leave_few_pairs(spark, monkeypatch):
    """Of many variants of one text, about half of which link, few pairs are left when the pivots are done; none that links is lost."""
    rng = random.Random(6)
    template = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = [(0, " ".join(template))]
    for i in range(1, 300):
        words = list(template)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            words[at] = f"n{rng.randrange(90_000)}"
        rows.append((i, " ".join(words)))
    made, last_pairs = [], shingle_join._last_pairs
    monkeypatch.setattr(shingle_join, "_last_pairs", lambda rest: made.append(last_pairs(rest).distinct().count()) or last_pairs(rest))
    sets, root = _linked(rows)
    got = {(r.doc_id, r.component_id) for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, root(i)) for i, _ in rows}
    assert len({root(i) for i, _ in rows}) < 150 and made[0] < len(rows)


def _moved(spark):
    """Bytes written for shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none, quantiles = context._jvm.java.util.ArrayList(), context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_stay_are_not_moved(spark):
    """What drops few rows shuffles few texts."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(400)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7]), (301, texts[8] + " tail"), (5, texts[5]), (302, None)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    benchmark = spark.createDataFrame([("q", " ".join(texts[3].split()[5:30]))], "item_id string, text string")
    whole = sum(len(t) for t in texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept, clean = one_of_each(docs), without_contaminated(docs, benchmark)
        at = _moved(spark)
        assert sorted(r.doc_id for r in kept.collect()) == [*range(300), 302]
        assert sorted(r.doc_id for r in clean.collect()) == sorted([i for i, _ in rows if i != 3])
        assert _moved(spark) - at < whole / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_judged_by_their_texts(spark):
    """Null ids, ids that repeat with other texts, rows that differ in other columns only, columns with any name, empty tables."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    a, b, c, d = (say(60) for _ in range(4))
    rows = [(7, a, "x"), (None, a, "x"), (7, b, "x"), (None, c, "x"), (None, c + " tail", "y"), (3, d, None), (3, d, "x"), (3, d, "x"), (4, None, "x"), (4, "", "x")]
    table = spark.createDataFrame([(i, t, x, "g", "a", 1, "k", "r") for i, t, x in rows], "doc_id long, text string, lang string, gone_id string, again_id string, key long, row string, digest string")
    kept = one_of_each(table)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(i is None for i, _ in got) == 1 and sorted(x for x in map(repr, got) if "None, 'v" not in x) == sorted(
        map(repr, [(7, a), (7, b), (3, d), (4, None), (4, "")])
    )
    # The same one in every run, however the rows are spread.
    assert _sorted(one_of_each(table.repartition(7)).collect()) == _sorted(kept.collect())
    benchmark = spark.createDataFrame([("q", " ".join(a.split()[5:30])), (None, " ".join(c.split()[:12]))], "item_id string, text string")
    clean = without_contaminated(table, benchmark)
    assert clean.columns == table.columns
    assert _sorted((r.doc_id, r.text) for r in clean.collect()) == _sorted((i, t) for i, t, _ in rows if t is None or t[:40] not in (a[:40], c[:40]))
    assert one_of_each(table.limit(0)).count() == without_contaminated(table.limit(0), benchmark).count() == 0


def test_scores(corpus, nothing):
    rows = [(r.doc_id, _words(r.text)) for r in corpus.collect()]
    for order in (2, 3):
        grams = lambda w, n: Counter(tuple(w[a : a + n]) for a in range(len(w) - n + 1))
        counts = [sum((grams(w, n) for _, w in rows), Counter()) for n in range(1, order + 1)]
        total = sum(len(w) for _, w in rows)
        want = []
        for doc, w in rows:
            own = [grams(w, n) for n in range(1, order + 1)]
            other = lambda t: counts[len(t) - 1][t] - own[len(t) - 1][t]  # noqa: B023, E731
            score = 0.0
            for i in range(len(w)):
                lost = 0
                for n in range(min(order, i + 1), 0, -1):
                    t = tuple(w[i - n + 1 : i + 1])
                    if other(t) > 0:
                        score += math.log(other(t) / (other(t[:-1]) if n > 1 else total - len(w)))
                        break
                    lost += 1
                else:
                    score -= math.log(total - len(w) + 1)
                score += lost * math.log(0.4)
            want.append((doc, len(w), round(score, 6)))
        got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in score_documents(corpus, order=order, block_bytes=4000).collect()]
        assert _sorted(got) == _sorted(want)
    assert score_documents(nothing).collect() == []


def test_scores_use_two_words_of_context(spark):
    """Where the last word alone leaves it open, the two before tell what comes next."""
    texts = ["a x c"] * 4 + ["b x d"] * 4 + ["a x c", "a x d"]
    rows = {r.doc_id: r.log_score for r in score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[8] - rows[9] > math.log(2)


def test_common_words_are_sent_by_number(spark, corpus, monkeypatch):
    """N-grams of common words keep apart by the numbers of their words, take fewer bytes than hashes, and score as with hashes."""
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(300)}".encode() for _ in range(200)] for _ in range(100)]
    words = Words(texts)
    for n in (1, 2, 3):
        hashes = np.unique(lm_scoring._grams(words, n, np.empty(0, np.uint64))[0][2])
        plain, (kind, at, keys) = lm_scoring._grams(words, n, np.unique(words.values))
        keys = np.unique(keys)
        assert (len(plain[1]), kind, len(at), len(keys)) == (0, 2 * n + 1, 100 * (201 - n), len(hashes))
        assert len(lm_scoring._squeezed(lm_scoring._steps(keys))) < 0.7 * len(lm_scoring._squeezed(lm_scoring._steps(hashes)))
    got = sorted(map(repr, score_documents(corpus, block_bytes=5000).collect()))
    monkeypatch.setattr(lm_scoring, "CODED", 40)
    assert sorted(map(repr, score_documents(corpus, block_bytes=9000).collect())) == got


def test_workers_hold_little_text_at_once(monkeypatch):
    """However large a batch is, sets are made of about a megabyte of text at a time."""
    texts = [(" ".join(f"{i}w{k}" for k in range(2000))).encode() for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts, pa.binary())], names=["doc_id", "key", "text"])
    seen, sets = [], shingle_join.shingle_sets
    monkeypatch.setattr(shingle_join, "shingle_sets", lambda texts: seen.append(sum(map(len, texts))) or sets(texts))
    late = type("Late", (), {"value": np.empty(0, np.uint64)})
    assert sum(x.num_rows for x in shingle_join._describe(40, late, iter([batch]))) == 400
    assert sum(seen) == sum(map(len, texts)) > 5 << 20 and max(seen) <= 1 << 20
