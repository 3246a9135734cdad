import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, of string, id long, key string"


def rows(texts, source="s"):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, "en", source if i % 3 else None, len(t or ""), "x", -1, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long, equal and repeated rows."""
    rnd = random.Random(7)
    words = ["ab", "the", "Zürich", "été", "x1", "don't", "naïve", "🙂", "qu", "end"]
    base = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(300))
    near = base.split()
    near[10] = "changed"
    texts = [None, "", "  \n\t ", "one", "one two three", base, base, base.replace(" ", "\n", 3), " ".join(near), "z" * 50_000, "long " * 40_000, "a b c d e f", "A B C D E F"]
    found = rows(texts)
    found += [found[5], (None, base, None, None, None, None, None, None), (None, "no id", "en", "s", 5, None, None, None)]
    return spark.createDataFrame(found, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
