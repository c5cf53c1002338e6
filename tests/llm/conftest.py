import random

import pytest

from isobarn.llm import common

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, task string, rank string, scan string, _t string, pos string"


def made_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    run = lambda n: " ".join(word() for _ in range(n))
    shared, long_ = run(60), run(3000)
    texts = [None, "", "  \n\t", "one", "ONE two", "😀 é " * 3, run(34), shared, f"{run(20)} {shared} {run(9)}", f"{shared}\n{run(3)}", long_, long_[:-4] + "zz"]
    texts += [run(rng.randint(1, 120)) for _ in range(20)]
    texts += ["mail a.b@c.de and 4111 1111 1111 1111 at 10.0.0.1 or +1 (437) 555-0689", "1.2.3.4.5.6.7.8 999.1.1.1 a@b.c_d@e.f 4111-1111-1111-1112"]
    rows = list(enumerate(texts))
    return rows + [rows[8], rows[10], (100, rows[10][1]), (None, shared), (7, "another text under a used id")]


@pytest.fixture(scope="session")
def rows():
    return made_texts()


@pytest.fixture(scope="session")
def documents(spark, rows):
    data = [(i, t, "en" if t and "é" in t else "xx", None, len(t) if t else None, *["clash"] * 7) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def _prepared(spark):
    common.prepare(spark)
