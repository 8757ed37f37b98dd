import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """A frame of several partitions from rows and a schema."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture(scope="session")
def docs(table):
    return lambda texts: table([(i, t, "en", f"src{(i or 0) % 12}", len(t or "")) for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a frame; nulls first."""
    return lambda df, *names: sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=lambda r: [(v is not None, v) for v in r])
