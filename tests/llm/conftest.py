import pytest

ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 3000, "word " * 900, "éü你好 \U0001f642", "tab\tand nbsp", "\\### Assistant: </turn> ok", "<|endoftext|> tail"]


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, with extra columns whose names operators use themselves."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), 7, "clash") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, kept string")

    return make


@pytest.fixture
def saved_docs(spark, tmp_path, docs_of):
    """A folder with documents.parquet of texts."""

    def make(texts):
        docs_of(texts).select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make
