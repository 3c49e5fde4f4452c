import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["token", "num_rows", "count"]
    assert df.count() > 0


def own_queries():
    """The queries of this library's operators proper."""
    from codeprep.plans import queries
    return set(queries.QUERIES)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert own_queries() <= set(E.oracle_sql())


def test_oracle_column_types_match(spark):
    """Column names and types agree between each query and its DuckDB statement."""
    import duckdb  # noqa: F401
    from oracle import duck
    from conftest import SF001
    con = duck(SF001)
    names = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
    for name in sorted(own_queries()):
        fn = E.queries()[name]
        st = {f.name: f.dataType.simpleString() for f in fn(spark, SF001).schema.fields}
        rel = con.sql(E.oracle_sql()[name])
        dt = {c: names.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
        assert dt == st, name
