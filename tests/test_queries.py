"""Every registered query against its oracle in DuckDB, on whole small tables."""

import duckdb
import pytest

from assayer.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    res = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_html_text_against_a_regex(spark, sf_dir, con):
    """Article paragraphs by a regular expression over the same pages."""
    import html as lib
    import re

    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    got = {r["page_id"]: r["text"] for r in catalogue.QUERIES["html_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    clean = lambda s: re.sub(r"\s+", "", lib.unescape(re.sub(r"<!--.*?-->|<[^>]*>", "", s, flags=re.S)))
    for k, page in pages.items():
        body = re.search(r"<article>(.*?)</article>", page, re.S)
        if body and got[k]:
            assert re.sub(r"\s+", "", got[k]) in clean(body.group(1)) or clean(body.group(1)).startswith(re.sub(r"\s+", "", got[k].split("\n\n")[0]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
