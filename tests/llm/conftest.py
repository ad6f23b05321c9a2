import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that operators make.
CLASHING = "score double, kept boolean, words array<string>, _digest string, _rank long, `a.b` map<string,string>"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns."""
    def make(pairs, extra=True):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        if not extra:
            return spark.createDataFrame(rows, SCHEMA)
        return spark.createDataFrame([r + (0.5, True, ["x"], "d", 7, {"k": "v"}) for r in rows], f"{SCHEMA}, {CLASHING}")
    return make
