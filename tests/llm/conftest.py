import pytest

#: Names that the operators use inside.
CLASHING = ("id", "th", "fp", "score", "label", "key", "part", "host", "length", "words", "nos", "ids", "component_id", "c0", "n_chars")
EDGES = [None, "", " \n\t ", "a", "one two three", "Ünï ▁ 日本 👍 <|endoftext|> &amp; <b>x</b>", "word " * 30_000, "x" * 60_000, "\n".join(["same line of some length here"] * 50)]


@pytest.fixture
def documents(spark):
    """Makes a table of documents from texts or (doc_id, text) pairs, with columns whose names clash."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, " + ", ".join(f"{c} long" for c in CLASHING)
        return spark.createDataFrame([(*r, *[None if k % 2 else 7 for k in range(len(CLASHING))]) for r in rows], schema)

    return make


@pytest.fixture
def edge_documents(documents):
    """Nulls, empty and very long texts, ties, repeated rows, a row without an id."""
    return documents(*EDGES, (3, "a"), (3, "another text under one id"), (4, "one two three"), (None, "no id"), (None, None))
