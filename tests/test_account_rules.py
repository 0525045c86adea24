from pitmill.operators import account_rules as rules

ROWS = [  # filing, place, indent, name, kind, amount
    (1, 1, 0, "Current assets", "BS", None),
    (1, 2, 1, "Cash", "BS", "1,200"),
    (1, 3, 1, "Receivables", "BS", "-"),
    (1, 4, 2, "Allowance", "BS", "-30"),
    (1, 5, 0, "Current liabilities", "BS", "0.4"),
    (1, 6, 1, "Cash", "BS", "7"),
    (1, 7, 1, "Notes", "BS", "0"),
    (1, 8, 2, "Cash", "BS", "5"),
    (1, 9, 0, "Cash", "BS", ""),
    (2, 1, 3, "Cash", "CIS", "9"),
]
CONTEXTS = [
    {"id": "notes", "priority": 5, "exact": ["Notes"], "action": "ignore"},
    {"id": "blank_header", "priority": 3, "children": True, "zero": True, "action": "push"},
    {"id": "swap", "priority": 4, "exact": ["Receivables"], "action": "replace", "label": "R"},
]
ACCOUNTS = [
    {"id": "debt", "priority": 2, "all": ["Cash"], "context_any": [["liabilities", "debts"]], "canonical": "OVERDRAFT"},
    {"id": "income", "priority": 3, "all": ["Cash"], "kinds": ["IS"], "canonical": "NONE", "fallback": "CASH_IS"},
    {"id": "asset", "priority": 1, "all": ["Cash"], "context_all": ["assets"], "context_none": ["liab"], "canonical": "CASH"},
]


def mapped(spark):
    df = spark.createDataFrame(ROWS, "filing int, place int, indent int, name string, statement_type string, amount string").repartition(3)
    df = rules.with_structure(df, ["filing"], "place", "indent", "amount")
    return rules.map_by_rules(rules.with_contexts(df, CONTEXTS, ["filing"], "place"), ACCOUNTS, ["OVERDRAFT", "CASH", "CASH_IS"])


def test_contexts_are_pushed_replaced_ignored_and_popped(spark):
    got = {(r.filing, r.place): (r.context_path, r.context_rule_id) for r in mapped(spark).collect()}
    assert got == {
        (1, 1): ("", "blank_header"),
        (1, 2): ("Current assets", ""),
        (1, 3): ("Current assets", "swap"),  # text that is no number is no zero
        (1, 4): ("R", ""),
        (1, 5): ("", "blank_header"),
        (1, 6): ("Current liabilities", ""),
        (1, 7): ("Current liabilities", "notes"),
        (1, 8): ("Current liabilities", ""),
        (1, 9): ("", ""),
        (2, 1): ("", ""),
    }


def test_one_name_maps_by_context_kind_and_known_accounts(spark):
    got = {(r.filing, r.place): (r.canonical_id, r.rule_id) for r in mapped(spark).where("name = 'Cash'").collect()}
    assert got == {(1, 2): ("CASH", "asset"), (1, 6): ("OVERDRAFT", "debt"), (1, 8): ("OVERDRAFT", "debt"), (1, 9): ("UNMAPPED", "default_unmapped"), (2, 1): ("CASH_IS", "income")}


def test_rules_need_no_join_and_no_rules_map_nothing(spark):
    df = rules.with_structure(spark.createDataFrame(ROWS, "filing int, place int, indent int, name string, statement_type string, amount string"), ["filing"], "place", "indent", "amount")
    plain = rules.map_by_rules(df.withColumn("context_path", df["name"]), ACCOUNTS, ["CASH"])
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    none = rules.map_by_rules(rules.with_contexts(df, [], ["filing"], "place"), [], [])
    assert {(r.canonical_id, r.context_path) for r in none.collect()} == {("UNMAPPED", "")}
