import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, kind string, spans string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""

    def build(rows, partitions=3):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", "z")
            for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build
