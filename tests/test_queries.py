"""Every query of the engine against its SQL."""

import duckdb
import pytest

from semloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", plans.SQL)
def test_query_is_its_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({plans.SQL[name]}) q").fetchall()
    assert canon(got) == canon(want)


def test_fuzzy_query(spark, sf):
    rows = plans.QUERIES["term_fuzzy_ratio"](spark, sf).collect()
    assert rows and all(r.ratio >= 0.8 for r in rows)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("missing", ["semloom.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without_the_corpus_parts(missing):
    """What can't be imported takes no other query along."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(plans.QUERIES) and out[1] == "False" and int(out[2]) >= len(plans.SQL)
