import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids in order) or from (id, text) pairs, over a few partitions."""
    def build(texts, extra="", langs=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, (langs or {}).get(i), f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3) if rows else df

    return build


@pytest.fixture(scope="session")
def rows():
    def collect(df, *names):
        return sorted((tuple(r) for r in df.select(*names).collect()), key=repr) if names else df.collect()

    return collect


