"""Factor graphs: a graph of typed nodes becomes one lazy plan.

Every node is a DataFrame (trade_date, security_id, value, is_valid, invalid_reason).
A builder takes its input frames in order, its config and the context, and
returns such a frame; ``register`` adds further types.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.cross_section import average_rank, neutralized, ordinal, quantile_exact, shrunk_z_score, z_score
from ..functions.semantics import divide, finite

KEYS = ["trade_date", "security_id"]
NODE = [*KEYS, "value", "is_valid", "invalid_reason"]


@dataclass
class Context:
    """``factors``: (trade_date, security_id, factor_id, factor_value); ``base``: every (trade_date, security_id) with its group columns."""

    factors: DataFrame
    base: DataFrame
    groups: dict[str, list[str]] = field(default_factory=lambda: {"market": [], "sector": ["sector"], "group": ["industry_group"]})

    def by(self, scope: str) -> list[str]:
        return ["trade_date", *self.groups[scope]]


Builder = Callable[[list[DataFrame], Mapping, Context], DataFrame]
NODE_TYPES: dict[str, Builder] = {}


def register(*names: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        for name in names:
            NODE_TYPES[name] = builder
        return builder

    return add


def result(frame: DataFrame, value: Column, reason: Column) -> DataFrame:
    """NULL and infinite results are invalid; the first reason given wins."""
    clean = finite(value)
    why = F.coalesce(reason, F.when(value.isNull(), "source_null"), F.when(clean.isNull(), "non_finite_result"))
    return frame.select(*KEYS, F.when(why.isNull(), clean).alias("value"), why.isNull().alias("is_valid"), why.alias("invalid_reason"))


def topological(graph: Mapping) -> list[str]:
    nodes = {n["id"] for n in graph["nodes"]}
    waiting = {n: {e["source"] for e in graph["edges"] if e["target"] == n} for n in nodes}
    order: list[str] = []
    while waiting:
        ready = sorted(n for n, s in waiting.items() if not s - set(order))
        if not ready:
            raise ValueError("the graph has a cycle or an unknown node")
        order += ready
        for n in ready:
            del waiting[n]
    return order


def build(graph: Mapping, context: Context) -> dict[str, DataFrame]:
    """All nodes' frames; nothing runs until one is used."""
    specs, frames = {n["id"]: n for n in graph["nodes"]}, {}
    for name in topological(graph):
        spec = specs[name]
        edges = sorted((e for e in graph["edges"] if e["target"] == name), key=lambda e: e.get("target_handle", ""))
        frames[name] = NODE_TYPES[spec["type"]]([frames[e["source"]] for e in edges], spec.get("config", {}), context)
    return frames


def run(graph: Mapping, context: Context) -> DataFrame:
    return build(graph, context)[graph["outputs"]["final_node_id"]]


#: Node types that look back, and how many rows of a security they need, the row itself included.
TEMPORAL: dict[str, Callable[[Mapping], int]] = {"lag": lambda c: c.get("periods", 1) + 1, "rolling_max": lambda c: c["window"], "rolling_min": lambda c: c["window"]}


def needs_history(graph: Mapping) -> set[str]:
    """The nodes above some temporal node: their frames must reach back; all others need the experiment's dates alone."""
    types = {n["id"]: n["type"] for n in graph["nodes"]}
    above = {n: {e["source"] for e in graph["edges"] if e["target"] == n} for n in types}
    found: set[str] = set()
    pending = [s for n, kind in types.items() if kind in TEMPORAL for s in above[n]]
    while pending:
        node = pending.pop()
        if node not in found:
            found.add(node)
            pending += above[node]
    return found


def row_limits(graph: Mapping, dates: Sequence[date]) -> dict[str, int]:
    """For a single date, the rows of a security that suffice of a factor which only temporal nodes read directly."""
    if len(set(dates)) != 1:
        return {}
    specs, history = {n["id"]: n for n in graph["nodes"]}, needs_history(graph)
    out = {}
    for name, spec in specs.items():
        below = [specs[e["target"]] for e in graph["edges"] if e["source"] == name]
        plain = spec["type"] == "factor_input" and spec.get("config", {}).get("missing") != "median"
        if plain and below and all(n["type"] in TEMPORAL and n["id"] not in history for n in below):
            out[name] = max(TEMPORAL[n["type"]](n.get("config", {})) for n in below)
    return out


def at_dates(frame: DataFrame, dates: Sequence[date]) -> DataFrame:
    """The rows of ``dates``; a table by month reads only their months."""
    days = sorted(set(dates))
    if "month" in frame.columns:
        frame = frame.where(F.col("month").isin(sorted({d.strftime("%Y-%m") for d in days})))
    return frame.where(F.col("trade_date").isin(days))


def up_to(frame: DataFrame, last: date) -> DataFrame:
    if "month" in frame.columns:
        frame = frame.where(F.col("month") <= last.strftime("%Y-%m"))
    return frame.where(F.col("trade_date") <= F.lit(last))


def build_dates(graph: Mapping, context: Context, dates: Sequence[date]) -> dict[str, DataFrame]:
    """All nodes' frames for the experiment's ``dates``.

    What a temporal node needs of the past travels to the nodes above it: these are built on
    all rows up to the last date, or for a single date on the last few of each security.
    Everything else is built on the dates alone, so its scan reads nothing else.
    """
    last, history, limits = max(dates), needs_history(graph), row_limits(graph, dates)
    narrow = Context(at_dates(context.factors, dates), at_dates(context.base, dates), context.groups)
    wide = Context(up_to(context.factors, last), up_to(context.base, last), context.groups)
    specs, frames = {n["id"]: n for n in graph["nodes"]}, {}
    for name in topological(graph):
        spec = specs[name]
        config = spec.get("config", {})
        edges = sorted((e for e in graph["edges"] if e["target"] == name), key=lambda e: e.get("target_handle", ""))
        keeps_past = name in history
        inputs = [frames[e["source"]] for e in edges]
        if not keeps_past and spec["type"] not in TEMPORAL:
            inputs = [at_dates(frame, dates) if e["source"] in history else frame for e, frame in zip(edges, inputs, strict=True)]
        if name in limits:
            newest = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
            rows = wide.factors.where(F.col("factor_id") == config["factor_id"]).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limits[name]).drop("_n")
            frames[name] = NODE_TYPES[spec["type"]](inputs, config, Context(rows, wide.base, context.groups))
            continue
        frame = NODE_TYPES[spec["type"]](inputs, config, wide if keeps_past or spec["type"] in TEMPORAL else narrow)
        frames[name] = at_dates(frame, dates) if spec["type"] in TEMPORAL and not keeps_past else frame
    return frames


def run_dates(graph: Mapping, context: Context, dates: Sequence[date], strict: bool = False) -> DataFrame:
    """The final node's rows at ``dates``; ``strict`` first requires a snapshot of every factor at each of them."""
    if strict:
        require_coverage(graph, context.factors, dates)
    final = graph["outputs"]["final_node_id"]
    return at_dates(build_dates(graph, context, dates)[final], dates)


def uncovered_dates(graph: Mapping, factors: DataFrame, dates: Sequence[date]) -> list[date]:
    """The dates at which some factor input of the graph has no row. One row a date reaches the driver."""
    wanted = sorted({n["config"]["factor_id"] for n in graph["nodes"] if n["type"] == "factor_input"})
    found = at_dates(factors, dates).where(F.col("factor_id").isin(wanted))
    if "source_date" in factors.columns:
        found = found.where(F.col("source_date") <= F.col("trade_date"))
    whole = found.groupBy("trade_date").agg(F.count_distinct("factor_id").alias("n")).where(F.col("n") >= len(wanted))
    return sorted(set(dates) - {r.trade_date for r in whole.select("trade_date").collect()})


def require_coverage(graph: Mapping, factors: DataFrame, dates: Sequence[date]) -> None:
    """Fail where a run would have to fall back on other than point-in-time snapshots."""
    ids = [n.get("config", {}).get("factor_id") for n in graph["nodes"] if n["type"] == "factor_input"]
    if not ids or not all(ids):
        raise ValueError("point-in-time runs need factor_input nodes with a factor")
    if any(i.startswith("lab_") for i in ids):
        raise ValueError("point-in-time runs do not take saved lab factors as inputs")
    missing = uncovered_dates(graph, factors, dates)
    if missing:
        raise ValueError("no complete snapshot at " + ", ".join(d.isoformat() for d in missing))


def with_groups(frame: DataFrame, context: Context, *by: str) -> DataFrame:
    """The group columns that ``by`` names; the day alone needs none."""
    asked = [c for c in dict.fromkeys(by) if c not in frame.columns]
    return frame.join(context.base.select(*KEYS, *asked), KEYS, "left") if asked else frame


def _joined(inputs: list[DataFrame], how: str = "inner") -> DataFrame:
    out = None
    for k, frame in enumerate(inputs):
        one = frame.select(*KEYS, F.col("value").alias(f"v{k}"), F.col("is_valid").alias(f"ok{k}"), F.col("invalid_reason").alias(f"why{k}"))
        out = one if out is None else out.join(one, KEYS, how)
    return out


@register("factor_input")
def factor_input(inputs, config, context):
    """A factor's values; with missing = "median", securities of the base without one get the day's exact median."""
    rows = context.factors.where(F.col("factor_id") == config["factor_id"]).select(*KEYS, finite("factor_value").alias("v"))
    if config.get("missing") != "median":
        return result(rows, F.col("v"), F.lit(None).cast("string"))
    middle = quantile_exact(rows, ["trade_date"], "v", {"_m": 0.5})
    full = context.base.select(*KEYS).join(rows, KEYS, "left").join(middle, "trade_date", "left")
    return result(full, F.coalesce("v", "_m"), F.lit(None).cast("string"))


@register("constant")
def constant(inputs, config, context):
    return result(context.base.select(*KEYS), F.lit(float(config["value"])), F.lit(None).cast("string"))


def _arithmetic(combine: Callable[[Column, Column], Column], division: bool = False) -> Builder:
    def builder(inputs, config, context):
        j = _joined(inputs)
        bad = F.when(~F.col("ok0"), F.col("why0")).when(~F.col("ok1"), F.col("why1"))
        if division:
            bad = bad.when(F.col("v1") == 0, "division_by_zero")
        return result(j, combine(F.col("v0"), F.col("v1")), bad)

    return builder


for _name, _combine in {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}.items():
    NODE_TYPES[_name] = _arithmetic(_combine)
NODE_TYPES["divide"] = _arithmetic(divide, True)
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


@register("compare")
def compare(inputs, config, context):
    j = _joined(inputs)
    bad = F.when(~F.col("ok0"), F.col("why0")).when(~F.col("ok1"), F.col("why1"))
    return result(j, COMPARE[config["op"]](F.col("v0"), F.col("v1")).cast("double"), bad)


@register("and", "or")
def logical(inputs, config, context):
    j = _joined(inputs)
    both = F.least("v0", "v1") if config["op"] == "and" else F.greatest("v0", "v1")
    return result(j, (both != 0).cast("double"), F.when(~F.col("ok0"), F.col("why0")).when(~F.col("ok1"), F.col("why1")))


@register("condition")
def condition(inputs, config, context):
    """The first input where the second is not zero."""
    j = _joined(inputs, "left")
    return result(j, F.col("v0"), F.when(~F.col("ok0"), F.col("why0")).when(~F.coalesce(F.col("v1") != 0, F.lit(False)), "condition_not_met"))


@register("condition_score")
def condition_score(inputs, config, context):
    """One value where the input is not zero and another where it is, over the whole base."""
    j = context.base.select(*KEYS).join(_joined(inputs), KEYS, "left")
    met = F.coalesce((F.col("v0") != 0) & F.col("ok0"), F.lit(False))
    return result(j, F.when(met, float(config.get("met", 1))).otherwise(float(config.get("unmet", 0))), F.lit(None).cast("string"))


@register("log", "sqrt", "abs", "negate")
def unary(inputs, config, context):
    v = F.col("value")
    value = {"log": F.when(v > 0, F.log(v)), "sqrt": F.when(v >= 0, F.sqrt(v)), "abs": F.abs(v), "negate": -v}[config["op"]]
    outside = {"log": v <= 0, "sqrt": v < 0}.get(config["op"], F.lit(False))
    return result(inputs[0], value, F.coalesce(F.col("invalid_reason"), F.when(outside, f"{config['op']}_domain")))


@register("winsorize")
def winsorize(inputs, config, context):
    by = context.by(config.get("scope", "market"))
    frame = with_groups(inputs[0], context, *by)
    bounds = quantile_exact(frame.where("is_valid"), by, "value", {"_low": config.get("low", 0.01), "_high": config.get("high", 0.99)})
    frame = frame.join(bounds, by, "left")
    return result(frame, F.greatest("_low", F.least("_high", "value")), F.col("invalid_reason"))


def _grouped(value: Callable[[Column, list[str], Mapping], Column], empty: str) -> Builder:
    def builder(inputs, config, context):
        by = context.by(config.get("scope", "market"))
        frame = with_groups(inputs[0], context, *by)
        found = value(F.col("value"), by, config)
        return result(frame, found, F.coalesce(F.col("invalid_reason"), F.when(found.isNull(), empty)))

    return builder


def _clipped(z: Column, config: Mapping) -> Column:
    z = -z if config.get("direction") == "lower" else z
    limit = config.get("clip")
    return z if limit is None else F.when(z.isNotNull(), F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), z)))


NODE_TYPES["zscore"] = _grouped(lambda v, by, c: _clipped(z_score(v, by, c.get("sample", False), c.get("min_count", 2)), c), "zscore_zero_std")
NODE_TYPES["neutralize"] = _grouped(lambda v, by, c: neutralized(v, by), "source_null")


@register("shrunk_zscore")
def shrunk(inputs, config, context):
    by = context.by(config.get("scope", "sector"))
    frame = with_groups(inputs[0], context, *by)
    z = shrunk_z_score(F.col("value"), by, ["trade_date"], config.get("strength", 10.0), config.get("min_count", 3))
    return result(frame, _clipped(z, config), F.coalesce(F.col("invalid_reason"), F.when(z.isNull(), "zscore_min_count")))


@register("rank", "dense_rank", "percent_rank", "dense_score", "bucket")
def ranks(inputs, config, context):
    """Ranks over the valid rows of a group; ties go by security."""
    by = context.by(config.get("scope", "market"))
    frame = with_groups(inputs[0].where("is_valid"), context, *by)
    v, down = F.col("value"), config.get("descending", True)
    n = F.count("*").over(Window.partitionBy(*by))
    kind = config["op"]
    if kind in ("rank", "dense_rank"):
        value = ordinal(v, by, "security_id", down)
    elif kind == "percent_rank":
        value = F.when(n == 1, 0.0).otherwise(divide(ordinal(v, by, "security_id", down) - 1, n - 1))
    elif kind == "bucket":
        value = F.ntile(config.get("buckets", 5)).over(Window.partitionBy(*by).orderBy(v.desc() if down else v.asc(), "security_id"))
    else:
        place = average_rank(v, by, not down) if config.get("ties") == "average" else ordinal(v, by, "security_id", not down)
        value = F.when(n == 1, 100.0).otherwise(divide(place - 1, n - 1) * 100)
    return result(frame, value.cast("double"), F.lit(None).cast("string"))


def in_time() -> WindowSpec:
    return Window.partitionBy("security_id").orderBy("trade_date")


@register("lag")
def lag(inputs, config, context):
    k = config.get("periods", 1)
    before = lambda c: F.lag(c, k).over(in_time())
    return result(inputs[0], before("value"), F.when(F.row_number().over(in_time()) <= k, "lag_insufficient_history").otherwise(before("invalid_reason")))


@register("rolling_max", "rolling_min")
def rolling(inputs, config, context):
    """All rows of the window must be there and valid."""
    n = config["window"]
    w = in_time().rowsBetween(-(n - 1), 0)
    value = (F.max if config["op"] == "max" else F.min)("value").over(w)
    bad = F.when(F.count("*").over(w) < n, "rolling_insufficient_history").when(F.count(F.when(F.col("is_valid"), 1)).over(w) < n, "rolling_input_invalid")
    return result(inputs[0], value, bad)


@register("weighted_score")
def weighted_score(inputs, config, context):
    """Weighted sum of all inputs; with renormalize, over the base by the weight of the inputs at hand."""
    weights = [float(w) for w in config["weights"]]
    if not config.get("renormalize"):
        j = _joined(inputs)
        bad = F.coalesce(*(F.when(~F.col(f"ok{k}"), F.col(f"why{k}")) for k in range(len(inputs))))
        return result(j, sum((F.col(f"v{k}") * w for k, w in enumerate(weights)), F.lit(0.0)), bad)
    j = context.base.select(*KEYS)
    for k, frame in enumerate(inputs):
        j = j.join(frame.where("is_valid").select(*KEYS, F.col("value").alias(f"v{k}")), KEYS, "left")
    active = sum((F.when(F.col(f"v{k}").isNotNull(), abs(w)).otherwise(0.0) for k, w in enumerate(weights)), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"v{k}") * w, F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    return result(j, divide(value * sum(map(abs, weights)), F.nullif(active, F.lit(0.0))), F.when(active == 0, "no_active_weight"))


def quality(frame: DataFrame) -> DataFrame:
    """Rows, valid rows, securities and dates of a run."""
    return frame.agg(F.count("*").alias("n_rows"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"), F.count_distinct("security_id").alias("n_securities"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def reasons(frame: DataFrame) -> DataFrame:
    return frame.where(~F.col("is_valid")).groupBy("invalid_reason").agg(F.count("*").alias("n_rows"))
