import pytest

# Extra columns with the names that the operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, `key` string, bucket bigint, "
    "digest string, mark bigint, size int, drops array<int>, row string, blob string, spans string, "
    "block bigint, pos int, root bigint, _slot bigint, n bigint"
)


@pytest.fixture
def docs(spark):
    """documents with clashing extra columns, from (doc_id, text) pairs."""
    def make(rows):
        width = SCHEMA.count(",") + 1
        full = [(i, t, None, "s", None if t is None else len(t)) + (None,) * (width - 5) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def odd_rows():
    """Null ids and texts, empty and long texts, repeated rows, and texts that share lines."""
    prose = " ".join(f"word{i % 37} of{i % 11}" for i in range(60))
    return [
        (1, prose), (2, prose), (2, prose), (3, None), (None, prose), (None, None), (4, ""), (5, ""), (6, " \n\t"),
        (7, "one two"), (8, "x" * 70_000), (9, "A b\n" * 3000), (10, prose + "\npassword: hunter22\n" + prose),
        (11, "É ß Σ" * 50), (None, ""), (12, "\n".join([prose, "", prose, "!!"])),
    ]
