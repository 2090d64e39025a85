from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

from portlens.llm.common import ship_code

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents out of (doc_id, text[, source]) rows."""
    ship_code(spark)

    def documents(rows: list[tuple]) -> DataFrame:
        full = [(r[0], r[1], None if r[0] is None else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return documents


def prose(seed: int, words: int) -> str:
    """Lines of made-up words, ended as sentences."""
    state, out = seed * 7919 + 17, []
    for n in range(words):
        state = (state * 1103515245 + 12345) % 2**31
        word = "".join("aeioulnrst"[(state >> k) % 10] for k in range(3, 3 + 3 * (2 + state % 4), 3))
        out.append(word + (".\n" if n % 9 == 8 else " "))
    return "".join(out).strip() + "."


ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b"), (5, "a b"), (6, "x\n" * 400), (7, "y" * 30_000), (8, "é ß 漢字 😀 \u0085 z" * 20)]
