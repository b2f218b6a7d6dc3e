"""Fixtures for the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


LONG = prose(1, 30_000)
A = prose(2, 120)
NEAR_A = " ".join(w if i not in (30, 70) else "changed" for i, w in enumerate(A.split()))

ROWS = [
    (1, A, "en", "s", 1), (2, A, "en", "s", 1), (2, A, "en", "s", 1), (None, A, "en", None, None), (3, NEAR_A, None, "t", 1), (4, prose(3, 120), "de", "t", 1),
    (5, "", "en", "s", 0), (6, "", None, "s", 0), (7, None, "en", "s", None), (8, None, None, None, None), (None, None, None, None, None), (9, LONG, "en", "s", 1),
    (10, "one", "", "s", 1), (11, "  \n\t ", "en", "s", 1), (12, "!!! ...", "en", "s", 1), (13, "é\u0000ß 日本語 \U0001f600", "ja", "s", 1), (14, LONG + " more", "en", "s", 1), (15, "one two", "en", "s", 1),
]


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The edge rows with columns named as the operators name theirs, and names equal but for case."""
    df = edge(spark)
    for name in ("part", "fp", "node", "bin_id", "shard", "wl_text", "tokens", "h", "term", "slot", "fp_0", "html"):
        df = df.selectExpr("*", f"7 AS `{name}`")
    return df.selectExpr("*", "0 AS `TEXT`", "map('a', 1) AS extra")


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
