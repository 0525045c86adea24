"""Accounts by rules on name, context, children and amount, over the lines of orders as rows of filings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import account_rules as rules
from ..sources.views import read

#: Which rows open a context: deeper rows follow, or an offer; economy parts never do.
CONTEXTS = [
    {"id": "economy", "priority": 30, "all": ["ECONOMY"], "action": "ignore"},
    {"id": "offer", "priority": 20, "all": ["PROMO"], "action": "push", "label": "OFFER"},
    {"id": "swap", "priority": 15, "kinds": ["IS"], "any": [["BRUSHED"]], "zero": False, "action": "replace"},
    {"id": "header", "priority": 10, "children": True, "action": "push"},
]
ACCOUNTS = [
    {"id": "offer_metal", "priority": 90, "context_all": ["OFFER"], "any": [["TIN", "NICKEL"]], "canonical": "METAL_ON_OFFER"},
    {"id": "offer_rest", "priority": 80, "context_any": [["OFFER"]], "none": ["COPPER"], "canonical": "ON_OFFER"},
    {"id": "free_header", "priority": 70, "children": True, "zero": True, "canonical": "SUBTOTAL"},
    {"id": "steel", "priority": 60, "all": ["STEEL"], "kinds": ["CIS"], "canonical": "STEEL_INCOME", "fallback": "STEEL"},
    {"id": "steel_under_small", "priority": 55, "all": ["STEEL"], "context_any": [["SMALL", "MEDIUM"]], "context_none": ["ANODIZED"], "canonical": "SMALL_STEEL"},
    {"id": "brass", "priority": 50, "any": [["BRASS"], ["STANDARD", "LARGE"]], "canonical": "BRASS"},
    {"id": "unknown", "priority": 40, "all": ["COPPER"], "canonical": "NO_SUCH_ACCOUNT"},
]
KNOWN = ["METAL_ON_OFFER", "ON_OFFER", "SUBTOTAL", "STEEL", "SMALL_STEEL", "BRASS"]


def _filings(spark, d):
    """Orders as filings: a line's part type is the account, its place tells the indent, its tax the amount."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_linestatus")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = lines.withColumn("place", place).join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    rows = rows.select("l_orderkey", "place", F.pmod(F.col("l_partkey") + F.col("place"), F.lit(4)).cast("int").alias("indent"), F.upper("p_type").alias("name"), F.when(F.col("l_linestatus") == "O", "BS").otherwise("IS").alias("statement_type"), F.floor(F.col("l_tax") * 100 + 0.5).alias("amount"))
    return rules.with_structure(rows, ["l_orderkey", "statement_type"], "place", "indent", "amount")


def _contexts(spark, d):
    return rules.with_contexts(_filings(spark, d), CONTEXTS, ["l_orderkey", "statement_type"], "place")


def context_stack(spark, d):
    """The contexts that are open at each row, with the rule that decided about the row itself."""
    return _contexts(spark, d).select("l_orderkey", "place", "indent", "context_rule_id", "context_path", "section_context")


def accounts_by_context(spark, d):
    """Accounts by rules: the same name maps by context, children and amount."""
    return rules.map_by_rules(_contexts(spark, d), ACCOUNTS, KNOWN).select("l_orderkey", "place", "statement_type", "canonical_id", "rule_id")


QUERIES = {f.__name__: f for f in (context_stack, accounts_by_context)}

_ROWS = """WITH RECURSIVE placed AS (
  SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS place, l_partkey, l_linestatus, l_tax FROM lineitem),
f AS (
  SELECT l_orderkey, place, CAST((l_partkey + place) % 4 AS INTEGER) AS indent, upper(p_type) AS name, CASE WHEN l_linestatus = 'O' THEN 'BS' ELSE 'IS' END AS kind, floor(l_tax * 100 + 0.5) = 0 AS is_zero
  FROM placed JOIN part ON l_partkey = p_partkey),
g AS (
  SELECT *, coalesce(lead(indent) OVER w > indent, false) AS kids, CAST(row_number() OVER w AS INTEGER) AS r FROM f WINDOW w AS (PARTITION BY l_orderkey, kind ORDER BY place)),
h AS (
  SELECT *, CASE WHEN contains(name, 'ECONOMY') THEN 'economy' WHEN contains(name, 'PROMO') THEN 'offer' WHEN kind = 'IS' AND contains(name, 'BRUSHED') AND NOT is_zero THEN 'swap' WHEN kids THEN 'header' ELSE '' END AS rule,
         CASE WHEN contains(name, 'PROMO') THEN 'OFFER' ELSE name END AS label FROM g),
walk AS (
  SELECT l_orderkey, kind, r, place, indent, rule, name, is_zero, kids, [] :: STRUCT(i INTEGER, l VARCHAR)[] AS here,
         CASE WHEN rule IN ('offer', 'swap', 'header') THEN [{'i': indent, 'l': label}] ELSE [] END AS after FROM h WHERE r = 1
  UNION ALL
  SELECT h.l_orderkey, h.kind, h.r, h.place, h.indent, h.rule, h.name, h.is_zero, h.kids, list_filter(w.after, lambda x: x.i < h.indent),
         CASE WHEN h.rule IN ('offer', 'header') THEN list_append(list_filter(w.after, lambda x: x.i < h.indent), {'i': h.indent, 'l': h.label})
              WHEN h.rule = 'swap' THEN list_append(list_filter(w.after, lambda x: x.i < h.indent)[:-2], {'i': h.indent, 'l': h.label})
              ELSE list_filter(w.after, lambda x: x.i < h.indent) END
  FROM walk w JOIN h ON h.l_orderkey = w.l_orderkey AND h.kind = w.kind AND h.r = w.r + 1),
c AS (SELECT *, array_to_string(list_transform(here, lambda x: x.l), ' > ') AS path FROM walk) """
SQL = {
    "context_stack": _ROWS + "SELECT l_orderkey, place, indent, rule AS context_rule_id, path AS context_path, coalesce(here[-1].l, '') AS section_context FROM c",
    "accounts_by_context": _ROWS + """SELECT l_orderkey, place, kind AS statement_type,
  CASE WHEN contains(path, 'OFFER') AND (contains(name, 'TIN') OR contains(name, 'NICKEL')) THEN 'METAL_ON_OFFER'
       WHEN contains(path, 'OFFER') AND NOT contains(name, 'COPPER') THEN 'ON_OFFER'
       WHEN kids AND is_zero THEN 'SUBTOTAL'
       WHEN contains(name, 'STEEL') AND kind = 'IS' THEN 'STEEL'
       WHEN contains(name, 'STEEL') AND (contains(path, 'SMALL') OR contains(path, 'MEDIUM')) AND NOT contains(path, 'ANODIZED') THEN 'SMALL_STEEL'
       WHEN contains(name, 'BRASS') AND (contains(name, 'STANDARD') OR contains(name, 'LARGE')) THEN 'BRASS' ELSE 'UNMAPPED' END AS canonical_id,
  CASE WHEN contains(path, 'OFFER') AND (contains(name, 'TIN') OR contains(name, 'NICKEL')) THEN 'offer_metal'
       WHEN contains(path, 'OFFER') AND NOT contains(name, 'COPPER') THEN 'offer_rest'
       WHEN kids AND is_zero THEN 'free_header'
       WHEN contains(name, 'STEEL') AND kind = 'IS' THEN 'steel'
       WHEN contains(name, 'STEEL') AND (contains(path, 'SMALL') OR contains(path, 'MEDIUM')) AND NOT contains(path, 'ANODIZED') THEN 'steel_under_small'
       WHEN contains(name, 'BRASS') AND (contains(name, 'STANDARD') OR contains(name, 'LARGE')) THEN 'brass'
       WHEN contains(name, 'COPPER') THEN 'unknown' ELSE 'default_unmapped' END AS rule_id
FROM c""",
}
