import pytest

from quillmetric.llm.work import Workspace

# columns whose names the operators use themselves
EXTRA = "size long, n_lines string, part int, _row string, _k1 long, copies int, `odd.name` string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), 7, "x", 1, "r", 5, 2, "o")


LONG = "All work and no play makes a dull corpus of words. " * 4000
EDGES = [
    row(1, None), row(2, "", None), row(3, "one"), row(4, "one", "b"), row(4, "one", "b"), row(None, "no id here", "c"),
    row(None, None, None), row(5, LONG), row(6, " \n\t \n"), row(7, "Ünïcode ☃ text – with 🎈 and \0 zero", "é"),
    row(8, "one two three four", ""), row(9, "double  blanks \n and\ttabs  ", "b"), row(10, "<|endoftext|> is text"),
]


@pytest.fixture
def work(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "work"))
    yield space
    space.drop()


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
