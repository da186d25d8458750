"""Batch jobs, policies, and small predicates over job and flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Actions by category, error texts that a retry may cure, and the attributes that find an element, best first.
CATEGORIES = {
    "navigate": "navigate", "click": "click", "hover": "click", "drag": "click", "type": "fill", "select": "fill", "upload": "fill", "evaluate": "eval",
    "screenshot": "snapshot", "pdf": "snapshot", "cookie_get": "state", "storage_get": "state", "cookie_set": "state_write", "storage_set": "state_write",
    "scroll": "scroll", "wait": "wait", "press": "interact",
}
INTERNAL = "_internal"
RECOVERABLE = (
    "timeout", "Timeout", "element not found", "element is detached", "Element is not attached", "waiting for selector", "Target closed", "Navigation failed",
    "frame was detached", "Execution context was destroyed",
)
FINDERS = ("data-testid", "data-test", "id", "name", "placeholder", "aria-label")


def pending(wanted: DataFrame, done: DataFrame, key: str = "url", retry_failed: bool = False) -> DataFrame:
    """What a resumed job still has to do; failures count as done unless asked otherwise."""
    rest = done.where("success") if retry_failed else done
    return wanted.join(rest.select(key), key, "left_anti")


def job_stats(results: DataFrame, job: str) -> DataFrame:
    out = results.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum("duration_ms").alias("duration_ms"),
    )
    return out.withColumn("progress_pct", F.floor((F.col("completed") + F.col("failed")) / F.col("total") * 100 + 0.5))


def shadowed(first: DataFrame, second: DataFrame, key: str = "name") -> DataFrame:
    """Both, where the second gives way to the first of the same name."""
    return first.withColumn("origin", F.lit("user")).unionByName(second.join(first.select(key), key, "left_anti").withColumn("origin", F.lit("built-in")))


def by_precedence(entries: DataFrame, keys: list[str], rank: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(rank)
    return entries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def category(action: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), action), F.lit("unknown"))


def policy(action: Column, deny: list[str], confirm: list[str], allow: list[str], default: str) -> Column:
    """deny, confirm or allow by the action's category, in this precedence; an action without one is "unknown"."""
    kind = category(action)
    hit = lambda rules: kind.isin(*rules) if rules else F.lit(False)
    return F.when(kind == INTERNAL, "allow").when(hit(deny), "deny").when(hit(confirm), "confirm").when(hit(allow), "allow").otherwise(default)


def recoverable(error: Column) -> Column:
    """Whether an error tells of a page's state; case counts, no error is none."""
    hit = F.lit(False)
    for w in RECOVERABLE:
        hit = hit | error.contains(w)
    return F.coalesce(hit, F.lit(False))


def step_of(event: Column, tag: Column) -> Column:
    """The flow step that a recorded browser event with a target becomes; ``tag``: the target's element, which may be unknown."""
    entry = event.isin("input", "change", "select")
    return F.when(event.isin("click", "submit"), "click").when(entry & (F.coalesce(tag == "select", F.lit(False)) | (event == "select")), "select").when(entry, "type")


def selector_of(attributes: Column) -> Column:
    """A CSS selector from the first telling attribute (map of names to values) that is not empty."""
    made = []
    for name in FINDERS:
        value = F.try_element_at(attributes, F.lit(name))
        made.append(F.when(value != "", F.concat(F.lit(f'[{name}="'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"]'))))
    return F.coalesce(*made)


def flow_inputs(defined: DataFrame, given: DataFrame) -> DataFrame:
    """(run, key, value, missing): every run's inputs, from its flow's definitions (flow, key, default, required) and what was
    given (run, flow, key, value; a null key stands for a run without inputs). Defaults fill in, undefined keys pass through;
    missing tells of a required input without a value."""
    runs = given.select("run", "flow").distinct()
    own = given.where("key is not null").select("run", "key", F.col("value").alias("given"))
    known = runs.join(defined, "flow").select("run", "key", "default", "required")
    both = known.join(own, ["run", "key"], "full")
    out = both.select("run", "key", F.coalesce("given", "default").alias("value"), F.coalesce("required", F.lit(False)).alias("required"))
    missing = F.col("required") & (F.coalesce("value", F.lit("")) == "")
    return out.select("run", "key", "value", missing.alias("missing")).where("value is not null or missing")


def parameter_candidates(actions: DataFrame, flow: str, order: str) -> DataFrame:
    """(flow, name, source, key, required, template, first) of recorded actions (type, selector, ref, text): the first action
    of each flow for every kind of parameter."""
    from harrow.functions import expr as E

    kind = E.parameter_kind(F.coalesce("selector", "ref", F.lit("")), F.coalesce("text", F.lit("")))
    found = actions.where("type = 'type'").select(flow, order, kind.alias("name")).where("name is not null")
    secret = F.col("name") != "query"
    key = F.when(secret, F.concat(F.lit("SKILL_"), F.upper("name"))).otherwise(F.col("name"))
    source = F.when(secret, "env").otherwise("input")
    out = found.groupBy(flow, "name").agg(F.min(order).alias("first")).withColumn("source", source).withColumn("key", key)
    return out.select(flow, "name", "source", "key", secret.alias("required"), F.concat(F.lit("{{"), "source", F.lit(":"), "key", F.lit("}}")).alias("template"), "first")
