"""Every catalogue query against its SQL twin on the small tables."""

import duckdb
import pytest

from sparkquarry.plans import catalog, catalog_more  # noqa: F401
from sparkquarry.sources.files import TABLES

DATA = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(0.0 if v == 0 else v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rel = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in place) for r in rel.fetchall())
    got = sorted(tuple(shown(v) for v in r) for r in df.select(*columns).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("folder", ["run", "run.parquet"])
def test_file_scan_counts_a_folder_of_parts_once(spark, duck, tmp_path, folder):
    root = tmp_path / folder
    for i, t in enumerate(TABLES):
        parts = [f"{t}.parquet"] if i % 3 == 0 else [f"{t}.parquet/part-{k}{'.parquet' * (i % 3 == 1)}" for k in range(3)]
        for name in [*parts, f"old/{t}.parquet"]:
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(b"x")
    (root / "other.parquet").write_bytes(b"x")
    for path in (str(root), f"file://{root}/"):
        got = catalog.QUERIES["file_scan"](spark, path).select("name", "suffix").collect()
        assert sorted(map(tuple, got)) == sorted(duck.sql(catalog.ORACLES["file_scan"]).fetchall())
