import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, source]) rows."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        for name in filter(None, extra.split()):  # columns whose names an operator uses itself
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
