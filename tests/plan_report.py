"""python tests/plan_report.py – physical-plan summary of every registered query,
planned as if every table were large (no automatic broadcast, no adaptive
re-planning): shuffles, sort-merge joins, explicit broadcasts, sort-based
aggregates and Python UDFs.  Queries that run jobs while being built
(checkpointed steps) are summarised for their final plan."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from codeprep.session import ensure_checkpoint_dir, get_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[8]", 8)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print("| query | shuffles | sort-merge joins | broadcasts | sort aggregates | Python UDF |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in E.queries().items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        ops = [re.sub(r"^[\s:|+*()0-9-]*", "", line) for line in plan.splitlines()]
        shuffles = sum(op.startswith("Exchange ") for op in ops)       # operator lines only
        reused = sum(op.startswith("ReusedExchange") for op in ops)
        print(f"| {name} | {shuffles}{f' (+{reused} reused)' if reused else ''} | {plan.count('SortMergeJoin')} "
              f"| {plan.count('BroadcastExchange')} | {plan.count('SortAggregate')} "
              f"| {'yes' if 'ArrowEvalPython' in plan or 'BatchEvalPython' in plan else ''} |", flush=True)
