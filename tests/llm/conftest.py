import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Small texts with copies, near copies, shared passages, short, empty, null and very long ones; columns that clash."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "po", "ra") for b in ("tan", "lis", "ver", "dom", "gar", "")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = say(61), []
    for i in range(60):
        words = say(rng.randint(30, 160))
        if i % 4 == 0:
            words[10:10] = passage
        if i % 7 == 0 and texts:
            words = [w if rng.random() > 0.02 else "changed" for w in rng.choice(texts).split()]
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[5] + " tail", "one two", "one two", "", None, "  \t\n ", " ".join(say(6000)), "12 34 !!"]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[2], "en", None, None, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
