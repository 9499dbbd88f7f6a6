import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts that every operator must take: null, empty, white space, one word, symbols, other scripts, controls, repeats.
ODD = [None, "", " \t\n", "word", "### $$$ |||", "Ünïcödé 中文 العربية 😀", "a\x00b \x1c c", "x " * 30, "same words here again\n" * 4, "A" * 20_000, "one two three four five six seven eight nine ten " * 300]


def row(k, text, lang="en", source="s"):
    return (k, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd texts, a repeated row, null keys, and columns whose names operators use inside."""
    rows = [(*row(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s"), 1, "x") for k, t in enumerate(ODD)]
    rows += [rows[7], (None, "text without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, f"{KIND}, score int, fp string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def sf():
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def labels(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
