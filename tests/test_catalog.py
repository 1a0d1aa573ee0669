"""Every query against its SQL, as the driver compares them: columns by name, rows as a multiset."""

import glob
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillgrid.plans import catalog, extras, live, pictures, stores  # noqa: F401 (registers its queries)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = Counter(tuple(r) for r in got.select(*columns).collect())
    assert rows
    if name in catalog.ORACLES:
        want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert rows == Counter(map(tuple, want))
