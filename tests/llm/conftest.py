import random

import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, lang) rows."""
    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        # Names that operators use for themselves.
        clash = ["component_id", "kept", "spans", "bands", "lang_pred", "score", "bucket", "place", "component", "node", "u", "v", "rule", "next"]
        return df.selectExpr("*", *[f"'x' AS {c}" for c in clash]) if extra else df
    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences over a small vocabulary."""
    def make(seed, n, size=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
