import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); extra columns clash with names that operators use."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", 1, 9.0, 7, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", score double, fp long, uid string").repartition(parts)

    return make
