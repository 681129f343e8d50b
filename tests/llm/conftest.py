import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, n long,"
    " `row` string, text__ string, size int, `group` string"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, la, s, None, 1.5, 7, "x", None, 3, "g") for i, t, la, s in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
