"""Every query beside its SQL twin, over the driver's smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

registry = importlib.import_module("siftwork.plans.registry")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(map(repr, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
