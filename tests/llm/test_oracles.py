"""The queries that SQL can express against it, on whole small tables."""

import duckdb
import pytest

from assayer.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    flat = lambda row: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)
    got = sorted((flat(r) for r in df.select(*cols).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(map(flat, want), key=repr)
