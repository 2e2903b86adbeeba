import duckdb
import pytest
from pathlib import Path


@pytest.fixture
def oracle(sf_dir):
    """Runs a DuckDB statement over the test tables."""

    def run(sql, **tables):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        for name, table in tables.items():
            con.execute(f"DROP VIEW IF EXISTS {name}")
            con.register(name, table)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        return sorted((dict(zip(names, r)) for r in found.fetchall()), key=lambda r: repr(sorted(r.items(), key=lambda x: x[0])))

    return run


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items(), key=lambda x: x[0])))
