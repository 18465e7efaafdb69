"""Every registered query against its oracle on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import verify  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidewatch.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def db(sf_dir):
    return verify.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, db, sf_dir, name):
    _, rows, same, note = verify.compare(spark, db, name, sf_dir)
    assert same is not False, note
    assert rows > 0


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
