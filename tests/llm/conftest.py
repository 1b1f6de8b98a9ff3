import pytest
from pyspark.sql import functions as F

WORDS = "the of and river stone cloud winter market simple garden number winding paper yellow letter".split()


def prose(seed: int, n: int) -> str:
    """n words that hardly ever repeat a sequence."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Documents with everything that may come up."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    lines = "\n".join(prose(k, 9) for k in range(20, 30))
    return [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),  # an exact copy
        (3, near, None, "a", None),  # a near copy
        (4, None, "en", None, None),
        (5, "", None, "b", 0),
        (6, " \n\t\x0b\x0c\r ", "de", "b", 7),
        (7, "word", "de", "b", 4),
        (8, lines, "en", "b", 1),
        (9, "intro line\n" + lines + "\nlast line", "en", "b", 1),
        (9, "intro line\n" + lines + "\nlast line", "en", "b", 1),  # a repeated row
        (None, prose(3, 80), "en", "c", 1),
        (10, "the same three words " * 300, "fr", "c", 1),
        (11, prose(4, 20_000), "en", "c", 1),  # very long
        (12, "x" * 50_000, "en", "c", 1),  # one very long word
        (13, "1234 5678 \u00a0 !!", "en", "c", 1),  # no letter
        (14, "É\u2003è <|endoftext|> 漢字 😀\u2028z", "fr", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame(odd_rows(), schema).repartition(3)
    extra = "_t _w _k _id _row _text _key _lines starts n_words n_removed kept ids at h n sid bins fold score rule host".split()
    return rows.withColumns({c: F.lit(7) for c in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
