import random

import pytest

RECORD = "name string, full_seq string, ltr5 string, internal string, ltr3 string, genome string, loaded_at timestamp, rec string, n int, keys string, place string"


@pytest.fixture(scope="session")
def make_records(spark):
    """Records from (name, ltr5, internal, ltr3), with columns whose names the operators use inside."""

    def make(rows, parts=3):
        data = [(n, None, a, b, c, "g", None, "x", 1, "y", "z") for n, a, b, c in rows]
        return spark.createDataFrame(data, RECORD).repartition(parts)

    return make


@pytest.fixture(scope="session")
def dna():
    rng = random.Random(5)
    return lambda n: "".join(rng.choice("ACGT") for _ in range(n))
