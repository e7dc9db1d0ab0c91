import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that operators might use for helper columns.
CLASHING = ("k", "tag", "n", "key", "fp", "score", "predicted", "line", "_tag", "_late", "_kept", "_at", "_blob", "found", "spans", "at", "h", "ids", "start")
WORDS = ["the", "of", "and", "Élan", "naïve", "größer", "tokens", "secret", "alpha", "beta", "gamma", "delta", "ab", "漢字", "😀", "x1", "42"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts of all sorts: null, empty, blank, very long, copies, near copies, repeated rows, a null key, negative keys."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)] + [(200 + i, base[0].replace("alpha", "beta", 1)) for i in range(3)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, None), (-5, base[3]), (304, "a"), (305, prose(rng, 6000)), (306, "=" * 700), (307, "\n".join(["a line that is repeated forty times over, whole"] * 40))]
    rows += [(0, base[0]), (0, base[0]), (None, base[7]), (308, base[1] + base[2])]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as a table, with null languages and columns whose names clash."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    kinds = [LongType(), StringType(), StringType(), StringType(), LongType()] + [StringType()] * len(CLASHING)
    rows = [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else "src0", len(t or ""), *(["x"] * len(CLASHING))) for n, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)])).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
