"""Personal data: patterns, and terms that give them away (information-theoretic sanitisation).

Four kinds are found by pattern. What they find are the protected entities. A term is a run of
letters (at least ``MIN_LETTERS``); it occurs with an entity where it is among the ``CONTEXT`` terms before or after it. Over all
documents, with document counts ``n``, the pointwise mutual information of entity and term is
``log2(n_et * N / (n_e * n_t))`` and the information content of the entity ``log2(N / n_e)``. A term
whose information about the entity reaches the share ``DISCLOSURE`` of that content discloses it: in the documents
that hold the entity it is generalised. Rare entities count, down to ``SUPPORT`` text. What keeps chance out is the information itself: over the
different texts in which the pair stands it must add up to ``log2(1 / CHANCE)`` bits. One text tells that much
from ``1 / CHANCE`` documents on, in smaller tables it takes more texts; exact copies are one text.

Everything is DataFrame functions. Offsets are code points: matches are set off by a control
character (one of the text's own is changed to another first, which keeps the length) and the
lengths of the pieces are summed.

Defined cases: a null text is empty; a null or repeated ``doc_id`` gives a row for each row; base
spans of different kinds may overlap, term spans never overlap a base span; other columns are kept
by ``sanitised`` and not looked at by ``personal_data``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seapoint.llm.staging import scratch, staged

CONTEXT = 3
MIN_LETTERS = 3
SUPPORT = 1
DISCLOSURE = 0.9
CHANCE = 0.01
GROUP = 256
KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

# The contract's patterns with possessive repetition and a start that is the end of the last match or no
# middle of a run: the same leftmost matches, without backtracking over long runs or deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{11}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MARK, _OTHER = "\u0001", "\u0002"
_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _pieces(text: Column, pattern: Column | str) -> Column:
    """Text between matches and matches, in turn."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    return F.split(marked, _MARK, -1)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, and not for every element that ``body`` looks at."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What all elements before each one come to, from 0 on. In groups, so that no long array is copied element by element."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(done: Column, value: Column) -> Column:
        return F.struct(combine(done["at"], value).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))

    def groups(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / GROUP).cast("int"))
        return F.transform(numbers, lambda g: F.aggregate(F.slice(whole, g * GROUP + 1, F.lit(GROUP)), start, step))

    def together(parts: Column) -> Column:
        before = F.aggregate(parts, start, lambda done, group: step(done, group["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda group, at: F.transform(group["out"], lambda x: combine(at, x))))

    return _bound(_bound(values, groups), together)


def _matches(text: Column, pattern: Column | str) -> Column:
    """All matches as (start, end, value, text before, text after)."""

    def spans(pieces: Column) -> Column:
        # Piece 2 i - 1 is match i, between the text before and after it.
        def span(i: Column, starts: Column) -> Column:
            at = F.get(starts, 2 * i - 1)
            value = F.get(pieces, 2 * i - 1)
            return F.struct(
                at.alias("start"),
                (at + F.char_length(value)).alias("end"),
                value.alias("value"),
                F.get(pieces, 2 * i - 2).alias("before"),
                F.get(pieces, 2 * i).alias("after"),
            )

        numbers = F.sequence(F.lit(1), F.floor(F.size(pieces) / 2).cast("int"))
        starts = _running(F.transform(pieces, lambda x: F.char_length(x)), lambda x, y: x + y)
        found = _bound(starts, lambda known: F.transform(numbers, lambda i: span(i, known)))
        return F.when(F.size(pieces) > 2, found.cast(_SPANS)).otherwise(F.array().cast(_SPANS))

    return _bound(_pieces(text, pattern), spans)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    spans = F.filter(_matches(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    return F.when(text.rlike(_NEED[kind]), spans).otherwise(F.array().cast(_SPANS))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{MIN_LETTERS},}}"), F.lit(0))


def _scanned(documents: DataFrame, doc: Column) -> DataFrame:
    """Rows with ``doc``, ``text``, the base spans, and ``row``, which stands for id and text."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    rows = documents.select(doc.alias("doc"), F.xxhash64(documents["doc_id"], text).alias("row"), text.alias("text"))
    rows = rows.select("*", *[_base(F.col("text"), k).alias(k) for k in KINDS])
    some = F.size(KINDS[0]) > 0
    for kind in KINDS[1:]:
        some = some | (F.size(kind) > 0)
    return rows.withColumn("some", some)


def _entities(scanned: DataFrame) -> DataFrame:
    """``row, entity, terms`` for every base span."""
    def named(kind: str) -> Column:
        def entity(s: Column) -> Column:
            value = F.lower(s["value"]) if kind == "email" else F.regexp_replace(s["value"], "[^0-9.]", "")
            return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("entity"), s["before"].alias("before"), s["after"].alias("after"))

        return F.transform(kind, entity)

    one = F.explode(F.concat(*[named(k) for k in KINDS])).alias("s")
    rows = scanned.filter("some").select("row", F.xxhash64("text").alias("copy"), one)
    before = F.reverse(_terms(F.col("s.before")))
    terms = F.array_distinct(F.concat(F.slice(before, 1, CONTEXT), F.slice(_terms(F.col("s.after")), 1, CONTEXT)))
    return rows.select("row", "copy", "s.entity", terms.alias("terms"))


def disclosing_terms(
    documents: DataFrame, entities: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE
) -> DataFrame:
    """``entity, term, share``: terms whose information about an entity reaches ``disclosure`` of its content, not by chance."""
    entities = entities.select("row", "copy", "entity", "terms")
    texts = documents.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    holders = entities.groupBy("entity").agg(F.countDistinct("row").alias("n_e"), F.countDistinct("copy").alias("texts"))
    pairs = (
        entities.select("row", "copy", "entity", F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.countDistinct("row").alias("n_et"), F.countDistinct("copy").alias("support"))
        .filter(F.col("support") >= support)
    )
    candidates = staged(pairs.join(holders.filter(F.col("texts") >= support), "entity"), "candidates")
    frequencies = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(texts.count())
    information = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    content = F.log2(n / F.col("n_e"))
    return (
        candidates.join(frequencies, "term")
        .withColumn("share", F.when(content > 0, information / content).otherwise(F.lit(0.0)))
        .filter((F.col("share") >= disclosure) & (F.col("support") * information >= math.log2(1 / CHANCE)))
        .select("entity", "term", "share")
    )


def _found(documents: DataFrame) -> DataFrame:
    """The scanned rows as a written table, with the text only where it is needed again."""
    rows = _scanned(documents, F.struct(documents["doc_id"]))
    return staged(rows.withColumn("text", F.when(F.col("some"), F.col("text"))), "personal")


def _terms_of_rows(documents: DataFrame, found: DataFrame, support: int, disclosure: float) -> DataFrame:
    """``row, terms``: the terms that disclose an entity of the row; ``found`` holds what they follow from."""
    entities = staged(_entities(found), "entities")
    flagged = staged(disclosing_terms(documents, entities, support, disclosure), "disclosing")
    return (
        entities.select("row", "entity")
        .distinct()
        .join(flagged, "entity")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("term")).alias("terms"))
    )


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with the spans of their disclosing terms in ``term``."""
    rows = rows.join(terms, "row", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    base = F.concat(*[F.col(k) for k in KINDS])
    spans = _bound(
        base,
        lambda known: F.filter(
            _matches(F.col("text"), pattern),
            lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        ),
    )
    return rows.withColumn("term", F.when(F.col("terms").isNotNull(), spans).otherwise(F.array().cast(_SPANS)))


def _listed(kinds: tuple[str, ...]) -> Column:
    def listed(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat(*[listed(k) for k in kinds])


def personal_data(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``doc_id``, the counts, ``base_sha256``, ``spans`` and ``n_term`` of every row."""
    found = _found(documents)
    with scratch(documents.sparkSession) as kept:
        terms = kept(_terms_of_rows(documents, found, support, disclosure), "terms")
    rows = _with_terms(found, terms)
    return rows.select(
        "doc.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(_listed(KINDS), ","), 256).alias("base_sha256"),
        F.array_join(_listed((*KINDS, "term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitised(documents: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``documents`` with every span replaced by the label of its kind; other columns unchanged.

    ``n_chars``, where there is one, is set to the new length. A null text stays null.
    """
    whole = _scanned(documents, F.struct(*[documents[c] for c in documents.columns]))
    with scratch(documents.sparkSession) as kept:
        terms = kept(_terms_of_rows(documents, _found(documents), support, disclosure), "terms")
    rows = _with_terms(whole, terms)

    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(LABELS[kind]).alias("label")))

    spans = F.array_sort(F.concat(*[labelled(k) for k in LABELS]))

    def replaced(found: Column) -> Column:
        # A span that ends within those before it says nothing new.
        covered = _running(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        parts = F.zip_with(found, covered, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), at.alias("at")))
        new = F.filter(parts, lambda s: s["end"] > s["at"])

        # Each group is cut out of the text first: a place far into a long text is looked for once a group.
        def pieces(part: Column) -> Column:
            first, last = part[0]["at"], F.element_at(part, -1)["end"]
            return _bound(
                F.substring(F.col("text"), first + 1, last - first),
                lambda cut: F.transform(
                    part, lambda s: F.concat(F.substring(cut, s["at"] - first + 1, F.greatest(s["start"] - s["at"], F.lit(0))), s["label"])
                ),
            )

        def groups(spans: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int"))
            return F.flatten(F.transform(numbers, lambda g: _bound(F.slice(spans, g * GROUP + 1, F.lit(GROUP)), pieces)))

        out = _bound(new, groups)
        return F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("at"), out.alias("out"))

    rows = rows.withColumn("done", F.when(F.size(spans) > 0, _bound(spans, replaced)))
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.char_length("text"))
    rows = rows.withColumn("clean", F.concat(F.array_join("done.out", ""), rest))
    changed = F.col("done").isNotNull()
    out = []
    for field in documents.schema.fields:
        column = F.col("doc").getField(field.name)
        if field.name == "text":
            column = F.when(changed, F.col("clean")).otherwise(column)
        elif field.name == "n_chars":
            column = F.when(changed, F.char_length("clean").cast(field.dataType)).otherwise(column)
        out.append(column.alias(field.name))
    return rows.select(*out)
