"""Ordered rules over statement rows, compiled to Columns, and the contexts that header rows open.

A rule is a dict. Conditions, all optional: ``kinds`` (statement types), ``exact``
(names), ``all``, ``none`` (parts of the name), ``any`` (groups of parts, one of each group),
the same for the context as ``context_all``, ``context_any``, ``context_none``, ``children`` and
``zero`` (true or false). The rule of the highest ``priority`` whose conditions hold decides, among equals the
first; it is one CASE expression, so rows are neither joined with rules nor shuffled.

Rows of one document are put in order once. Context rules say what a row does when it
has been read: ``push`` opens a context at the row's indent, ``replace`` takes the place of the innermost one and
``ignore``, like no rule, leaves the contexts. A row closes all contexts that are not
less deep than itself. A context's label is the row's name or the rule's ``label``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNMAPPED = "UNMAPPED"
#: Statement types that rules of the other one fit too: income statements, alone or with other comprehensive income.
ALIKE = {"IS": ["IS", "CIS"], "CIS": ["IS", "CIS"]}


def zero_or_blank(amount: Column) -> Column:
    """Whether an amount (number or text with thousands separators) is absent or cut to zero; other text is neither."""
    text = F.trim(F.regexp_replace(F.coalesce(amount.cast("string"), F.lit("")), ",", ""))
    return (text == "") | F.coalesce(F.abs(text.try_cast("double")) < 1, F.lit(False))


def with_structure(rows: DataFrame, document: Sequence[str], order: str, indent: str, amount: str) -> DataFrame:
    """Add has_children (the next row of the document is deeper) and is_zero."""
    w = Window.partitionBy(*document).orderBy(order)
    return rows.withColumn("has_children", F.coalesce(F.lead(indent).over(w) > F.col(indent), F.lit(False))).withColumn("is_zero", zero_or_blank(F.col(amount)))


def condition(rule: dict, name: Column, kind: Column, context: Column) -> Column:
    """Whether a rule's conditions hold; a rule without any fits every row."""

    def text(of: Column, prefix: str = "") -> Iterable[Column]:
        yield from (F.contains(of, F.lit(part)) for part in rule.get(f"{prefix}all", []))
        yield from (reduce(Column.__or__, [F.contains(of, F.lit(part)) for part in group]) for group in rule.get(f"{prefix}any", []) if group)
        yield from (~F.contains(of, F.lit(part)) for part in rule.get(f"{prefix}none", []))

    found = [*text(name), *text(context, "context_")]
    if rule.get("exact"):
        found.append(name.isin(list(rule["exact"])))
    if rule.get("kinds"):
        found.append(kind.isin(sorted({k for given in rule["kinds"] for k in ALIKE.get(given, [given])})))
    found += [F.col(column) == F.lit(bool(rule[key])) for key, column in (("children", "has_children"), ("zero", "is_zero")) if rule.get(key) is not None]
    return F.coalesce(reduce(Column.__and__, found, F.lit(True)), F.lit(False))


def first_match(rules: Sequence[dict], values: Sequence[str], name: Column, kind: Column, context: Column) -> Column:
    """The struct (rule_id and ``values`` as text) of the rule that decides; null where none fits."""
    of = lambda rule: F.struct(F.lit(rule["id"]).alias("rule_id"), *(F.lit(rule.get(v)).cast("string").alias(v) for v in values))
    ordered = sorted(rules, key=lambda rule: -rule.get("priority", 0))
    none = F.lit(None).cast(T.StructType([T.StructField(f, T.StringType()) for f in ("rule_id", *values)]))
    if not ordered:
        return none
    start, *rest = ordered
    return reduce(lambda found, rule: found.when(condition(rule, name, kind, context), of(rule)), rest, F.when(condition(start, name, kind, context), of(start))).otherwise(none)


def with_contexts(rows: DataFrame, rules: Sequence[dict], document: Sequence[str], order: str, indent: str = "indent", name: str = "name", kind: str = "statement_type") -> DataFrame:
    """Add context_path (the open contexts from the outermost in, joined by " > "), section_context (the innermost) and context_rule_id.

    ``rows`` have has_children and is_zero (``with_structure``). The stack is an ordered pass over the
    rows of each document, which lie together in one partition; only the open contexts are kept.
    """
    decided = first_match(rules, ["action", "label"], F.col(name), F.col(kind), F.lit(""))
    rows = rows.withColumn("_decided", decided).withColumn("context_rule_id", F.coalesce("_decided.rule_id", F.lit("")))
    rows = rows.withColumn("_action", F.col("_decided.action")).withColumn("_label", F.coalesce("_decided.label", F.col(name))).drop("_decided")
    kept = [c for c in rows.columns if c not in ("_action", "_label")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("context_path", T.StringType()), T.StructField("section_context", T.StringType())])

    def fold(batches):
        current, stack = None, []
        for batch in batches:
            paths, sections = [], []
            for key, depth, action, label in zip(batch[list(document)].itertuples(index=False, name=None), batch[indent], batch["_action"], batch["_label"], strict=True):
                if key != current:
                    current, stack = key, []
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                paths.append(" > ".join(open_label for _, open_label in stack))
                sections.append(stack[-1][1] if stack else "")
                if action == "replace" and stack:
                    stack.pop()
                if action in ("push", "replace"):
                    stack.append((depth, label))
            yield batch[kept].assign(context_path=pd.Series(paths, dtype="object", index=batch.index), section_context=pd.Series(sections, dtype="object", index=batch.index))

    return rows.repartition(*document).sortWithinPartitions(*document, order).mapInPandas(fold, schema)


def map_by_rules(rows: DataFrame, rules: Sequence[dict], known: Sequence[str], name: str = "name", kind: str = "statement_type", context: str = "context_path") -> DataFrame:
    """Add canonical_id and rule_id: what the deciding rule says if it is a known account, else its ``fallback`` if that is, else UNMAPPED."""
    found = first_match(rules, ["canonical", "fallback"], F.col(name), F.col(kind), F.coalesce(F.col(context), F.lit("")))
    is_known = lambda c: F.col(c).isin([*known, UNMAPPED])
    account = F.when(is_known("_rule.canonical"), F.col("_rule.canonical")).when(is_known("_rule.fallback"), F.col("_rule.fallback")).otherwise(UNMAPPED)
    return rows.withColumn("_rule", found).withColumn("canonical_id", account).withColumn("rule_id", F.coalesce("_rule.rule_id", F.lit("default_unmapped"))).drop("_rule")
