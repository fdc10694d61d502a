import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 8


def whole(name):
    """Sorted rows of a query's SQL, columns in the order of their names."""
    with duckdb.connect() as db:
        for table in ("events", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        found = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted((tuple(str(r[k]) for k in order) for r in found.fetchall()))


def rows(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


CORE = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")) or n in ("offset_progress", "ordering_of_runs"))


@pytest.mark.parametrize("name", CORE)
def test_query_matches_its_sql(spark, name):
    assert rows(spark, name) == whole(name)


def test_every_core_query_has_sql():
    assert {n for n in entry.queries() if n in CORE or not n.startswith(("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "pipeline"))} == set(CORE)


def test_whole_log_and_whole_sets(spark, monkeypatch):
    """Nothing is cut: every offset of the log has its digest, and the sets beyond the mark are coded whole."""
    assert len(rows(spark, "cpu_worker_chain")) == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    monkeypatch.setitem(globals(), "FOLDER", "/root/testdata/sf0.01")
    for name in ("commit_metadata", "commit_payload"):
        assert rows(spark, name) == whole(name)
    coded = {r.part: r.offs for r in entry.queries()["metadata_round_trip"](spark, FOLDER).groupBy("part").agg(F.max("off").alias("offs")).collect()}
    assert min(coded.values()) > 1000
