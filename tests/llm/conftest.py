import pytest

#: A schema with extra columns whose names clash with the operators' own.
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size bigint, copies string, taken int, key string, removed string, n int, component string, kept string, found string, h int"


@pytest.fixture
def documents(spark):
    """Builds a documents table, with clashing extra columns, from (doc_id, text[, lang, source])."""

    def build(*rows):
        full = []
        for r in rows:
            doc, text, lang, source = (*r, "en", "s0")[:4] if len(r) == 2 else (*r, "s0")[:4]
            full.append((doc, text, lang, source, None if text is None else len(text), 7, 8, "c", 9, "k", "r", 1, "x", "y", "z", 2))
        return spark.createDataFrame(full, CLASHING)

    return build


@pytest.fixture
def awkward(documents):
    """Nulls everywhere, empty and blank texts, repeated rows, and one very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return documents((1, "hello world this is fine"), (1, "hello world this is fine"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here at all"), (None, None), (5, long), (6, "one", None, None))
