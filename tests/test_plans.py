"""Plan-shape guards: the scale properties the design relies on."""

import re

from pyspark.sql import functions as F

from codeprep.functions import text as T
from codeprep.operators import filters as FL
from codeprep.operators import joins as J
from codeprep.operators import tokens as TK
from codeprep.plans import fixtures as X
from codeprep.plans import queries as Q
from conftest import SF001


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_obfuscation_has_one_text_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if every table were large
    try:
        code = X.code_c(spark, SF001).select("doc_id", T.lex_input_raw("code").alias("code"))
        plan = physical(TK.obfuscate(code))
        # every exchange is the by-id repartition of raw text (one per branch or reused),
        # none keyed by (doc_id, tok) for the join and none by doc_id for the collect
        parts = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", plan)
        assert parts and all(re.fullmatch(r"doc_id#\d+L, \d+", keys) and why == "REPARTITION_BY_NUM"
                             for keys, why in parts), parts
        # one exchange, reused by the second branch (the text moves once)
        assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) - plan.count("ReusedExchange") == 1
        assert "SortMergeJoin" in plan and "SortAggregate" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokenizer_evaluated_once(spark):
    df = Q.token_vocabulary(spark, SF001)
    assert physical(df).count("regexp_extract_all(") == 1
    scan = [line for line in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines()
        if line.startswith("ReadSchema")]
    assert scan == ["ReadSchema: struct<doc_id:bigint,text:string>"]


def test_keep_where_semantics_and_partitioning(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, s string").repartition(4, "id")
    out = FL.keep_where(df, F.length("s") > 0)
    assert [r["id"] for r in out.collect()] == [1]           # null predicate drops the row
    assert out.columns == ["id", "s"]
    assert "Exchange" not in physical(out).split("Generate")[0]  # no exchange above the gate


def test_checked_broadcast_bound(spark):
    small = spark.range(10)
    big = spark.range(100)
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    b = J.checked_broadcast(small, max_rows=50)
    assert b.count() == 10 and "broadcast" in b._jdf.queryExecution().analyzed().toString().lower()
    nb = J.checked_broadcast(big, max_rows=50)
    assert "broadcast" not in nb._jdf.queryExecution().analyzed().toString().lower()


def test_top_k_per_group_limits_before_shuffle(spark):
    from codeprep.functions import constants as K
    assert K.KEYWORD_HITS <= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    plan = physical(Q.keyword_search(spark, SF001))
    assert plan.count("WindowGroupLimit") == 2      # partial (map side) and final


def test_row_caps_have_no_single_task_and_no_whole_group(spark):
    """The caps of 50,000 rows and more are cuts of a distributed numbering."""
    plan = physical(Q.row_cap_per_language(spark, SF001))
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Window [row_number" not in plan


def test_partition_helpers(spark):
    from codeprep.session import partition_by_key, spread_if_narrow
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")           # one file: narrower than the cluster
    spread = spread_if_narrow(docs, "doc_id")
    assert "REPARTITION_BY_NUM" in physical(spread) and spread.rdd.getNumPartitions() == n
    wide = spark.range(100)                                             # not a file scan: unchanged
    assert spread_if_narrow(wide, "id") is wide
    by_key = partition_by_key(docs, "doc_id")
    assert by_key.rdd.getNumPartitions() == n                           # explicit count, not coalesced


def test_accepted_files_search_once(spark, monkeypatch):
    """Numbering reads its input several times: it is given a written table, not the search."""
    seen = []
    monkeypatch.setattr(Q.D, "capped", lambda hits, *a: seen.append(hits) or hits.limit(0))
    Q.accepted_files(spark, SF001)
    plan = physical(seen[0])
    assert "regexp_extract_all(" not in plan and "Window" not in plan


def test_prepared_tokens_are_renamed_without_shuffle(spark):
    """Behind the length filter rows are renamed where they are; both ways give the same rows."""
    df = spark.range(3).selectExpr("id as doc_id", "array('int', 'x', ';') as t").repartition(2, "doc_id")
    out = TK.obfuscate(df, tokens_col="t", repartition=False, max_tokens=1000)
    plan = physical(out)
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    assert sorted(map(str, out.collect())) == sorted(map(str, TK.obfuscate(df, tokens_col="t").collect()))
