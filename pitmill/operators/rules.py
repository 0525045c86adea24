"""Rule tables applied to rows: mapping by text, weighted classification, priorities and checks.

A rule set is a small table of parameters, broadcast; distinct texts are matched
once and joined back, so that the theta join does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE = "rule int, canonical string, exact string, all_of array<string>, any_of array<string>, none_of array<string>"


def rule_table(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Rules {canonical, exact, all, any, none} in order of priority."""
    rows = [(k, r["canonical"], r.get("exact"), r.get("all", []), r.get("any", []), r.get("none", [])) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def map_accounts(rows: DataFrame, text: str, rules: DataFrame, unmapped: str = "UNMAPPED") -> DataFrame:
    """Add canonical: the first rule whose conditions all hold for the text."""
    names = rows.select(text).distinct()
    has = lambda part: F.contains(F.col(text), part)
    fits = (F.col("exact").isNull() | (F.col(text) == F.col("exact"))) & F.forall("all_of", has) & ((F.size("any_of") == 0) | F.exists("any_of", has)) & ~F.exists("none_of", has)
    best = names.join(F.broadcast(rules), fits).groupBy(text).agg(F.min_by("canonical", "rule").alias("canonical"))
    return rows.join(best, text, "left").withColumn("canonical", F.coalesce("canonical", F.lit(unmapped)))


def classify(rows: DataFrame, text: str, patterns: DataFrame, least: float = 0.0) -> DataFrame:
    """Add code and confidence: the code with the largest sum of weights of its patterns (code, pattern, weight, priority)."""
    names = rows.select(text).distinct()
    hits = names.join(F.broadcast(patterns), F.expr(f"{text} RLIKE pattern")).groupBy(text, "code").agg(F.sum("weight").alias("w"), F.min("priority").alias("p"))
    best = hits.groupBy(text).agg(F.max(F.struct("w", -F.col("p"), "code")).alias("b"), F.sum("w").alias("total"))
    best = best.select(text, F.col("b.code").alias("code"), (F.col("b.w") / F.col("total")).alias("confidence")).where(F.col("confidence") >= least)
    return rows.join(best, text, "left")


def drop_empty_subtotals(rows: DataFrame, key: list[str], amount: str, order: list[str]) -> DataFrame:
    """Of rows with one key keep the first in order; zero amounts go first if another amount exists."""
    w = Window.partitionBy(*key)
    kept = rows.withColumn("_some", F.max(F.abs(amount) > 0).over(w)).where(~F.col("_some") | (F.abs(amount) > 0))
    return kept.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_some", "_r")


def prefer_statement(rows: DataFrame, key: list[str], first: str, second: str, kind: str = "statement_type") -> DataFrame:
    """Rows of the second statement go where the first one has the same key."""
    w = Window.partitionBy(*key)
    has = F.max(F.col(kind) == first).over(w)
    return rows.withColumn("_has", has).where(~((F.col(kind) == second) & F.col("_has"))).drop("_has")


def outline(rows: DataFrame, document: list[str], order: str, indent: str) -> DataFrame:
    """Whether the next row of a document is deeper."""
    w = Window.partitionBy(*document).orderBy(order)
    return rows.withColumn("has_children", F.coalesce(F.lead(indent).over(w) > F.col(indent), F.lit(False)))


def context_paths(rows: DataFrame, document: list[str], order: str, indent: str, text: str) -> DataFrame:
    """The names of the rows above each row, by a stack that a row's indent cuts.

    An ordered fold: rows are sorted within the partitions that hold whole
    documents, and read once; only the stack of the document at hand is kept.
    """

    def fold(batches):
        current, stack = None, []
        for batch in batches:
            paths = []
            for key, depth, name in zip(batch[document].itertuples(index=False, name=None), batch[indent], batch[text], strict=True):
                if key != current:
                    current, stack = key, []
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                paths.append(" > ".join(n for _, n in stack))
                stack.append((depth, name))
            yield batch.assign(path=paths)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", path string"
    return rows.repartition(*document).sortWithinPartitions(*document, order).mapInPandas(fold, schema)


def checks(wide: DataFrame, key: list[str], formulas: dict[str, tuple[str, str]], absolute: float = 1.0, relative: float = 0.01) -> DataFrame:
    """One row a check: left and right side, their difference, and PASS, FAIL or SKIP where a side is missing."""
    sides = F.array(*(F.struct(F.lit(n).alias("check_id"), F.expr(a).cast("double").alias("left_side"), F.expr(b).cast("double").alias("right_side")) for n, (a, b) in formulas.items()))
    out = wide.select(*key, F.explode(sides).alias("c")).select(*key, "c.*").withColumn("difference", F.col("left_side") - F.col("right_side"))
    limit = F.greatest(F.lit(absolute), F.abs("right_side") * relative)
    return out.withColumn("status", F.when(F.col("difference").isNull(), "SKIP").when(F.abs("difference") <= limit, "PASS").otherwise("FAIL"))


def amounts_by_pattern(rows: DataFrame, key: list[str], picks: dict[str, tuple[str, list[str] | None, bool]], tie: str, name: str = "account_name", amount: str = "amount") -> DataFrame:
    """For each of ``picks`` (column -> (pattern, statement types, without sign)) the amount of the largest size among the accounts that fit."""

    def pick(pattern: str, kinds: list[str] | None, size: bool):
        fits = F.col(name).rlike(pattern) & F.col(amount).isNotNull()
        if kinds:
            fits &= F.col("statement_type").isin(kinds)
        found = F.max_by(F.when(fits, F.col(amount)), F.when(fits, F.struct(F.abs(amount), -F.col(tie))))
        return F.abs(found) if size else found

    return rows.groupBy(*key).agg(*(pick(*p).alias(c) for c, p in picks.items()))


def map_facts(facts: DataFrame, rules: Sequence[tuple[int, str, str, str]], forms: Sequence[str], unmapped: str = "UNMAPPED") -> DataFrame:
    """Facts of the given forms with canonical_id and fiscal_month, by rules (priority, part, text, canonical); a part is tag, label or note."""
    canonical = None
    for _, part, text, to in sorted(rules):
        fits = F.contains(F.col(part), F.lit(text))
        canonical = F.when(fits, to) if canonical is None else canonical.when(fits, to)
    found = F.lit(unmapped) if canonical is None else canonical.otherwise(unmapped)
    return facts.where(F.col("form").isin(list(forms))).withColumn("canonical_id", found).withColumn("fiscal_month", F.month("end_date"))


def with_overrides(classified: DataFrame, overrides: DataFrame, key: str, code: str, confidence: str, least: float) -> DataFrame:
    """Manual classes (key, override) win; what rules decide with less confidence than ``least`` is marked for review."""
    out = classified.join(overrides, key, "left")
    manual = F.col("override").isNotNull()
    return out.select(key, F.coalesce("override", code).alias(code), F.when(manual, "override").otherwise("rule").alias("source"), (~manual & (F.coalesce(confidence, F.lit(0.0)) < least)).alias("needs_review"))


#: Metrics that stand in for sold quantities. Fixed values.
QUANTITY_PROXIES = ["shipment_volume", "capacity", "utilization_rate"]


def normalize_metrics(raw: DataFrame) -> DataFrame:
    """Add metric_name, value_type, product_name and flags to rows (metric_id, unit, segment, product)."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    flags = F.concat_ws(",", F.when(F.startswith("unit", F.lit("inferred")), "UNIT_INFERRED"), F.when(F.col("metric_id").isin(QUANTITY_PROXIES), "QUANTITY_PROXY_USED"))
    name = F.initcap(F.regexp_replace("metric_id", "_", " "))
    return raw.withColumn("metric_name", name).withColumn("value_type", F.when(F.startswith("metric_id", F.lit("derived_")), "derived").otherwise("reported")).withColumn("product_name", F.coalesce(blank("product"), blank("segment"), F.lit("company"))).withColumn("flags", flags)


AMOUNT_POLICIES, CASH_DIRECTIONS = ["as_reported", "absolute", "negate", "negative_absolute"], ["inflow", "outflow"]


def with_sign_policy(rows: DataFrame, accounts: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add amount_policy, cash_direction and normalized_amount: the row's rule decides, else its account, else its statement type.

    ``accounts``: (canonical_id, policy, direction) and ``defaults``: (statement_type,
    policy, direction), tables of parameters. Unknown policies mean as reported.
    """
    out = rows.join(F.broadcast(accounts.toDF("canonical_id", "_ap", "_ad")), "canonical_id", "left").join(F.broadcast(defaults.toDF("statement_type", "_dp", "_dd")), "statement_type", "left")
    given = lambda *cs: F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in cs))
    policy, direction = given("rule_policy", "_ap", "_dp"), given("rule_direction", "_ad", "_dd")
    out = out.withColumn("amount_policy", F.when(policy.isin(AMOUNT_POLICIES), policy).otherwise("as_reported")).withColumn("cash_direction", F.when(direction.isin(CASH_DIRECTIONS), direction).otherwise(""))
    a = F.col("amount")
    turned = F.when(F.col("amount_policy") == "absolute", F.abs(a)).when(F.col("amount_policy") == "negate", -a).when(F.col("amount_policy") == "negative_absolute", -F.abs(a)).otherwise(a)
    return out.withColumn("normalized_amount", turned).drop("_ap", "_ad", "_dp", "_dd")
