"""Chains: named steps over DataFrames, each a view for the later ones, some under a condition on earlier counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import expr as E


def run_chain(spark: SparkSession, given: dict[str, DataFrame], steps: list[dict], out: str) -> DataFrame:
    """Run the steps in order; a step whose condition is false is skipped, and a failing step ends the chain.

    Steps stay lazy: only the counts that conditions name are computed, each once.
    """
    scope, mark = dict(given), f"c{uuid.uuid4().hex[:8]}_"
    counts: dict[str, int] = {}

    def holds(condition: str) -> bool:
        import re

        for name in re.findall(r"\$(\w+)\.count", condition):
            if name in scope and name not in counts:
                counts[name] = scope[name].count()
        variables = json.dumps({k: {"count": n} for k, n in counts.items()})
        return spark.range(1).select(E.condition(condition, F.lit(variables))).first()[0]

    for step in steps:
        if step.get("when") and not holds(step["when"]):
            continue
        sql = step["sql"]
        for name, df in scope.items():
            df.createOrReplaceTempView(mark + name)
            sql = _named(sql, name, mark + name)
        scope[step["name"]] = spark.sql(sql)
    return scope[out]


def _named(sql: str, name: str, view: str) -> str:
    import re

    return re.sub(rf"(?i)\b(FROM|JOIN)\s+{re.escape(name)}\b", lambda m: f"{m[1]} {view} AS {name}", sql)
