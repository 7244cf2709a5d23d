import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, __n string, score double, shard int"


def rows_of(texts, first=0):
    """Documents with further columns whose names the operators use too."""
    return [(first + i, t, "en", f"s{i % 4}", None if t is None else len(t), 7, -1, "x", 0.5, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Prose, copies, near copies, shared passages, nulls, blanks and a very long text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgäé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [prose(rng.randint(1, 120)) for _ in range(60)]
    out += [out[3]] * 4 + [out[5]] * 3
    base = prose(300)
    for _ in range(12):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    passage = prose(60)
    out += [prose(20) + " " + passage + " " + prose(20) for _ in range(10)]
    out += [None, "", None, "", "  \n\t ", "one", "one two", "ONE two", "a" * 700, "ab " * 300, prose(6000), "🙂 é " * 80]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = rows_of(texts)
    rows += [rows[3], rows[3]]  # rows repeated whole
    rows += [(None, "no id here at all", None, None, None, 1, 1, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def store(spark, tmp_path):
    """Write tables to a folder, for queries that take one."""

    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return put
