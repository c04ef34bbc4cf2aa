import pytest

#: A column that clashes with names that operators use inside.
EXTRA = ", id long, score double, fp long, h long, rule string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to documents (doc_id, text, lang, source, n_chars) with extra columns."""

    def make(rows):
        full = []
        for i, x in enumerate(rows):
            x = dict(x)
            text = x.get("text")
            full.append((x.get("doc_id", i), text, x.get("lang", "en"), x.get("source", "src0"), len(text) if text is not None else None, -1, -1.0, -1, -1, "r"))
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{EXTRA}")

    return make
