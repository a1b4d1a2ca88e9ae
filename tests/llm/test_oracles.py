"""Every query that SQL can express against its DuckDB SQL, and the list of the others."""

import duckdb
import pytest

import corpus_pipeline
from panelspark.llm import queries

from ..conftest import SF001


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    # brute-force versions of these are in the tests of their modules and of the pipeline
    assert set(queries.QUERIES) - set(queries.SQL) == {"op1_token_counts", "op2_best_fit_packing", "op5_decontamination", "op8_language_id", "op11_embedding_whitening"}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    res = con.execute(queries.SQL[name])
    columns, want = [c[0] for c in res.description], res.fetchall()
    df = queries.QUERIES[name](spark, SF001)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
