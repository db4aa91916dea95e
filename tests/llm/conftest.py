import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) pairs."""

    def make(rows, extra=""):
        data = [(i, t, "en", "s", len(t) if t is not None else None, *(0 for _ in extra.split(",") if extra)) for i, t in rows]
        return spark.createDataFrame(data, SCHEMA + "".join(f", {c} int" for c in extra.split(",") if extra))

    return make
