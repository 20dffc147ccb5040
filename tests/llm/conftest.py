import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, raw string, rid string, spans string, bucket string, size string, label string"


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated
    rows, repeated ids, other scripts."""
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    base = words(rng, 200, stock)
    near = base.split()
    near[100] = "changed"
    passage = words(rng, 90, stock)
    texts = [None, "", "", " \n\t ", "one", "one two three", base, base, " ".join(near), words(rng, 150, stock) + " " + passage, passage + " " + words(rng, 20, stock), "ab" * 900, ("again and again the same line of words\n") * 40, words(rng, 30000, stock), "日本語 テキスト é́ ﬁ 𝔘 " * 30, "x\x00y \x1c z\r\n", "12345 !!! 678"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (6, base, "en", "s2", 7), (6, base, "en", "s2", 7), (-5, "negative " * 60, "de", None, 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
