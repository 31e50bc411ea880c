"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import canon, sql_rows

from driftline import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", [n for n in Q if n in SQL])
def test_equals_sql(spark, name):
    got, want = Q[name](spark, SMALL).toPandas(), sql_rows(SQL[name], SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", [n for n in Q if n not in SQL])
def test_without_sql_repeats_itself(spark, name):
    first, again = Q[name](spark, SMALL).toPandas(), Q[name](spark, SMALL).repartition(3).toPandas()
    assert len(first) and canon(first) == canon(again)


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_audit_lists_every_hypothesis(spark):
    got = Q["h3_audit_by_hypothesis"](spark, SMALL).collect()
    every = {r.hypothesis_id for r in Q["h1_healing_decisions"](spark, SMALL).collect()}
    assert len(every) > 1 and {r.hypothesis_id for r in got} == every
    assert [r.hypothesis_id for r in got] == sorted(r.hypothesis_id for r in got)
    assert all(b.outcome == "success" for a, b in zip(got, got[1:], strict=False) if a.hypothesis_id == b.hypothesis_id)
