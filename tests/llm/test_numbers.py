"""Vectors, personal data, mixing and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from seapoint.llm.components import connected_components
from seapoint.llm.mixing import document_rates, fit_rates, mixed
from seapoint.llm.pii import GROUP, personal_data, sanitised
from seapoint.llm.vector_join import link_vectors


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(None, 1), (5, 5)]
    label = {}
    for a, b in pairs:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 8))
    rows = [(i, (base[i % 25] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.12).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [0.0] * 8), (205, [1.0, None] * 4), (206, [float("nan")] * 8), (207, [float("inf")] * 8), (208, [1.0, 2.0]), (209, [2.0, 4.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cls string")
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.sum(v)) and np.any(v)}
    near = {a: {b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95} for a in good}
    label = {a: a for a in good}
    for _ in range(len(good)):
        label = {a: min([label[a], *(label[b] for b in near[a])]) for a in good}
    want = {i: (len(near.get(i, ())), label.get(i, i)) for i, _ in rows}
    for parts in ({}, {"cell_rows": 20, "part_rows": 7}):
        got = link_vectors(frame, **parts).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert link_vectors(frame.limit(0)).collect() == []


def test_vectors_of_any_scale_link(spark):
    """Only the direction counts, also where squares of components leave the range of doubles."""
    rows = [(i, [x * scale, 2 * x * scale, -x * scale]) for i, (x, scale) in enumerate([(1.0, 1e200), (1.1, 1e-200), (3.0, 1.0), (1.0, 5e-324), (1.7, 1e307)])]
    rows += [(9, [0.0, 1.0, 2.0]), (10, [0.0, 5e-324, 1e-323])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 9: (1, 9), 10: (1, 9)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(value):
    digits = [int(c) for c in value if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def _base(text):
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if _luhn(m[0])]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


CASES = [
    "mail a.b+c@x-y.co.uk, or a@b.c_d@e.f", "no@dot and @x.y and a@b..c a@b.c..d", "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000.001.2.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 4111111111111111 " + "4" * 9000, "call +49 (0)30 123456-7 or +1 2 or +1-800-555-0199.", "é😀 a@b.cd \u0001 x@y.zz \u0001\u0001 q@r.st",
    "", None, "x" * 40_000, "1." * 3000, "a@" * 500 + "b.c", "+49 30 12345678 1.2.3.4 4111 1111 1111 1111",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 3, "s", "r") for i, t in enumerate(CASES)] + [(None, CASES[0], 3, "s", "r"), (0, CASES[0], 3, "s", "r")], "doc_id long, text string, n_chars long, spans string, row string")
    got = personal_data(docs).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        want = _base(CASES[r.doc_id or 0] or "")
        assert r.spans == ",".join(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone"))
    clean = {r.doc_id: r for r in sanitised(docs).filter("doc_id > 0").collect()}
    assert sanitised(docs).columns == docs.columns
    assert clean[2].text == "ip [IP] [IP].[IP] 256.1.1.1 [IP]" and clean[7].text is None and clean[8].text == CASES[8]

    assert personal_data(docs.limit(0)).collect() == [] and sanitised(docs.limit(0)).collect() == []


def test_base_spans_of_a_list(spark):
    """Thousands of matches in one text, as in a directory; offsets are right beyond every group of pieces."""
    text = " ".join(f"é{i} u{i}@host{i % 7}.org, +49 30 {1000000 + i} at 10.0.{i % 300}.{i % 256};" for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "u1@host1.org"), (3, text[:-1])], "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    want = _base(text)
    assert len(want) > 10 * GROUP
    assert [x for x in rows[1].spans.split(",") if not x.startswith("term:")] == want
    assert rows[2].spans == "email:0:12" and rows[3].base_sha256 == rows[1].base_sha256
    clean = sanitised(docs.filter("doc_id = 3")).first().text
    assert clean.count("[EMAIL], [PHONE] at ") == 1500 and clean.count("[IP]") == sum(x.startswith("ip") for x in want)
    assert clean.startswith("é0 [EMAIL]") and "@" not in clean


def test_disclosing_terms(spark):
    """A name that only ever stands beside one address gives it away; a word that others use does not."""
    told = [(i, f"note {i} from Zebulon common at z@home.org about topic{i}") for i in range(8)]
    other = [(100 + i, f"a common note about number {i}") for i in range(60)] + [(200, "Zebulonx is another word")]
    docs = spark.createDataFrame(told + other, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    for i, text in told:
        at = text.index("Zebulon")
        assert f"term:{at}:{at + 7}" in rows[i].spans and "email:" in rows[i].spans
        common = text.index("common")
        assert f"term:{common}:" not in rows[i].spans
    assert all(rows[i].spans == "" for i, _ in other)
    assert "[TERM] common at [EMAIL]" in sanitised(docs).filter("doc_id = 3").first().text


def test_terms_of_rare_entities(spark):
    """A name beside an address of one, two or four texts gives it away; where all is rare, chance does not."""
    told = [(10 * n + i, f"note {i} from {name} common at {name[0]}@home.org today") for n, name in ((1, "Abimelech"), (2, "Bathsheba"), (4, "Cornelius")) for i in range(n)]
    other = [(100 + i, f"a common note from us about number {i} at home today") for i in range(200)]
    docs = spark.createDataFrame(told + other, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data(docs).collect()}
    for i, text in told:
        at = text.index(" from ") + 6
        assert [x for x in rows[i].spans.split(",") if x.startswith("term:")] == [f"term:{at}:{at + 9}"]
    assert all(rows[i].spans == "" for i, _ in other)
    assert sanitised(docs).filter("doc_id = 10").first().text == "note 0 from [TERM] common at [EMAIL] today"
    few = {r.doc_id: r.n_term for r in personal_data(docs.filter("doc_id = 10 OR doc_id BETWEEN 100 AND 120")).collect()}
    assert len(few) == 22 and set(few.values()) == {0}


def test_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rates = document_rates(docs, labels)
    met = rates.agg(*[(F.sum(F.col("n_tokens") * F.col(f"p_{k}") * F.col("rate")) / F.sum("n_tokens")).alias(k) for k in ("high", "low", "toxic")], F.min("rate").alias("least")).first()
    assert met.least >= 0
    assert met.high == pytest.approx(0.8, abs=0.01) and met.low == pytest.approx(0.2, abs=0.01) and met.toxic < 0.01
    assert rates.count() == docs.count()


def _met(rows, factors):
    rates = [max(0.0, 1.0 + float(np.dot(p, factors))) for _, p in rows]
    return sum(n * np.array(p) * r for (n, p), r in zip(rows, rates)) / sum(n for n, _ in rows)


@pytest.mark.parametrize("pure", [True, False])
def test_rates_of_rare_domains(spark, pure):
    """A wanted domain with a thousandth of the tokens reaches its target, with soft posteriors too."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2000):
        own = 0 if i < 2 else 2 if i < 42 else 1
        p = np.exp(np.eye(3)[own] * (60 if pure else 8) + rng.normal(size=3) * (0 if pure else 2))
        rows.append((100.0, (p / p.sum()).tolist()))
    frame = spark.createDataFrame(rows, "n double, p array<double>")
    names = ["high", "low", "toxic"]
    factors = fit_rates(frame, names, {"high": 0.8, "low": 0.2, "toxic": 0.0})
    assert _met(rows, factors) == pytest.approx([0.8, 0.2, 0.0], abs=1e-5 if pure else 1e-2)
    with pytest.raises(RuntimeError, match="did not converge"):
        fit_rates(frame, names, {"high": 0.8, "low": 0.2, "toxic": 0.0}, steps=1)
    with pytest.warns(UserWarning, match="misses its targets by up to 0.8"):
        never = fit_rates(frame.selectExpr("n", "array(0D, p[1], p[2]) AS p"), names, {"high": 0.8, "low": 0.2})
    assert np.isfinite(never).all()


def test_rates_of_odd_tables(spark, corpus, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert document_rates(corpus, labels).count() == corpus.count()
    assert set(document_rates(corpus, labels.limit(0)).columns) == {"doc_id", "n_tokens", "p_all", "rate"}
    assert document_rates(nothing, labels).collect() == []
    out = mixed(corpus, labels.limit(0))
    assert out.columns == [*corpus.columns, "sampling_rate"] and out.count() == corpus.count()


def test_rates_by_language(spark):
    """Each language meets the targets by itself, so its share of the tokens stays."""
    counts = {("en", 1): 180, ("en", 0): 20, ("de", 1): 60, ("de", 0): 140}
    kinds = [kind for kind, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, "fine words here" if q else "poor words here", k) for i, (k, q) in enumerate(kinds)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(kinds)], "doc_id long, quality int, toxic int")
    got = mixed(docs, labels, {"high": 0.8, "low": 0.2}, by="lang").groupBy("lang", "text").agg(F.avg("sampling_rate").alias("rate")).collect()
    want = {("en", "fine"): 160 / 180, ("en", "poor"): 2.0, ("de", "fine"): 160 / 60, ("de", "poor"): 40 / 140}
    assert {(r.lang, r.text[:4]): r.rate for r in got} == pytest.approx(want, rel=0.02)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "pii", "mixing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "sampling_rate"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 100 < len(ids) <= docs.count()
    assert {f"op{i}_" for i in range(1, 11)} <= {re.match(r"(op\d+_)|", k)[0] for k in __spark_entry__.queries()}
