import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from risklens.session import build_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="risklens-tests", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: df["doc_id"] * 0 for c in extra.split()}) if extra else df

    return make
