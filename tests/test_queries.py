"""Every registered query against its SQL."""

import os

import pytest

from tests.compare import DATA, connect, differences
from lineamix.plans.catalog import QUERIES
from lineamix.plans.oracle import ORACLE

SF = os.path.join(DATA, os.environ.get("LINEAMIX_TEST_SF", "sf0.001"))
# The smallest data has too few suppliers per nation for pairs.
MAY_BE_EMPTY = {"lineage_pairs", "lineage_similarity", "similarity_wide", "similarity_cells", "study_similarity"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    frame = QUERIES[key](spark, SF)
    problems = differences(frame, duck, ORACLE[key])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if key in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert not problems


def test_other_queries_stay_when_something_of_the_training_part_is_missing(monkeypatch, capsys):
    import importlib

    import __spark_entry__ as entry
    from lineamix.plans.catalog import QUERIES

    real = importlib.import_module

    def missing(name, *args):
        if name in ("lineamix.llm.catalog", "corpus_pipeline"):
            raise ImportError("No module named 'public_tokenizers'", name="public_tokenizers")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(QUERIES) and not any(k.startswith("op") for k in entry.oracle_sql())
    assert "public_tokenizers" in capsys.readouterr().err
