"""Registered queries: the base rules, as data, over facts and entity types of all tables; patterns over classes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.operators import rules
from factloom.plans.shared import QUERIES, SQL, query, table

_THIRD = lambda key, n, plus=0: f"CAST(CAST(floor(({key} + {plus}) / {n}) AS BIGINT) AS STRING)"
#: Facts for rules, from whole tables: owners, parts, makers, founders and leaders; groups that share one are small by their making.
RULE_FACTS = f"""SELECT 'line ' || l_orderkey || '-' || l_linenumber AS subject, 'owned_by' AS predicate, 'order ' || l_orderkey AS object, 'stable' AS stability FROM lineitem
 UNION ALL SELECT 'order ' || o_orderkey, 'owned_by', 'customer ' || o_custkey, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'volatile' ELSE 'semi_stable' END FROM orders
 UNION ALL SELECT 'Order ' || o_orderkey, 'subsidiary_of', 'customer ' || o_custkey, 'stable' FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT 'customer ' || c_custkey, 'operates', 'depot ' || {_THIRD("c_custkey", 5)}, 'semi_stable' FROM customer
 UNION ALL SELECT 'customer ' || o_custkey, 'enables', 'order ' || o_orderkey, 'semi_stable' FROM orders
 UNION ALL SELECT DISTINCT 'order ' || l_orderkey, 'requires', 'part ' || l_partkey, 'stable' FROM lineitem
 UNION ALL SELECT 'part ' || p_partkey, 'is_a', p_type, 'stable' FROM part
 UNION ALL SELECT DISTINCT p_type, 'is_a', 'goods', 'unknown' FROM part
 UNION ALL SELECT DISTINCT p_type, 'uses', p_brand, 'volatile' FROM part
 UNION ALL SELECT 'supplier ' || s_suppkey, 'founded_by', 'person ' || {_THIRD("s_suppkey", 3)}, 'stable' FROM supplier
 UNION ALL SELECT DISTINCT 'person ' || {_THIRD("s_suppkey", 3)}, 'known_for', 'nation ' || s_nationkey, 'semi_stable' FROM supplier
 UNION ALL SELECT 'customer ' || c_custkey, 'led_by', 'person ' || {_THIRD("c_custkey", 4)}, 'volatile' FROM customer
 UNION ALL SELECT 'supplier ' || s_suppkey, 'manufactures', 'model ' || {_THIRD("s_suppkey", 4)}, 'stable' FROM supplier
 UNION ALL SELECT 'supplier ' || s_suppkey, 'publishes', 'model ' || {_THIRD("s_suppkey", 4, 1)}, 'semi_stable' FROM supplier
 UNION ALL SELECT 'supplier ' || s_suppkey, 'same_as', 'supplier ' || (s_suppkey + 1), 'stable' FROM supplier WHERE s_suppkey % 8 = 0"""
RULE_TYPES = f"""SELECT 'order ' || o_orderkey AS entity, 'service' AS type FROM orders
 UNION ALL SELECT 'customer ' || c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'product' ELSE 'organization' END FROM customer
 UNION ALL SELECT 'supplier ' || s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'person' ELSE 'organization' END FROM supplier
 UNION ALL SELECT DISTINCT 'person ' || {_THIRD("c_custkey", 4)}, 'person' FROM customer WHERE c_custkey % 28 >= 4
 UNION ALL SELECT DISTINCT 'person ' || {_THIRD("s_suppkey", 3)}, 'person' FROM supplier WHERE s_suppkey % 21 >= 3"""
_NAMES = ("lineitem", "orders", "customer", "supplier", "part")


def read(spark, sf_dir, sql: str, *names: str):
    """A SELECT over the tables of ``sf_dir``."""
    names = names or _NAMES
    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names if f"{{{t}}}" in sql})


def rule_facts(spark, sf_dir, rule: rules.Rule | None = None):
    """The facts; for a rule only the branches that can hold its predicates, so other tables aren't read."""
    if rule is None:
        return read(spark, sf_dir, RULE_FACTS)
    wanted = {q for _, p, _ in (*rule.body, *rule.unless) for q in (rules.CLASSES[rule.classes[p]] if p in rule.classes else (p,))}
    branches = RULE_FACTS.split("\n UNION ALL ")
    kept = [b for b in branches if any(f"'{q}'" in b for q in wanted)]
    named = f"SELECT * FROM ({' UNION ALL '.join(kept)}) AS f(subject, predicate, object, stability)"
    return read(spark, sf_dir, named)


def rule_sql(rule: rules.Rule) -> str:
    """SQL of a rule's inferences: one row of facts for each pattern, equal variables, guards and exclusions."""
    score = "CASE {0}.stability WHEN 'stable' THEN 1.0 WHEN 'semi_stable' THEN 0.7 WHEN 'volatile' THEN 0.3 ELSE 0.5 END::DOUBLE"
    at: dict[str, str] = {}
    where: list[str] = []

    def match(pattern, alias):
        out = []
        for column, term in zip(("subject", "predicate", "object"), pattern, strict=True):
            place = f"{alias}.{column}"
            if term in rule.classes:
                out.append(f"{place} IN ({', '.join(repr(q) for q in rules.CLASSES[rule.classes[term]])})")
            if not term.startswith("?"):
                out.append(f"{place} = '{term}'")
            elif term in at:
                out.append(f"lower({place}) = lower({at[term]})")
            else:
                at[term] = place
        return out

    for n, pattern in enumerate(rule.body):
        where += match(pattern, f"f{n}")
    where += [f"lower({at[v]}) IN (SELECT lower(entity) FROM ty WHERE type IN ({', '.join(map(repr, types))}))" for v, types in rule.guards.items()]
    where += [f"NOT EXISTS (SELECT 1 FROM rf u{n} WHERE {' AND '.join(match(pattern, f'u{n}'))})" for n, pattern in enumerate(rule.unless)]
    term = lambda t: at[t] if t.startswith("?") else f"'{t}'"
    scores = ", ".join(score.format(f"f{n}") for n in range(len(rule.body)))
    return f"""WITH rf AS ({RULE_FACTS}), ty AS ({RULE_TYPES})
    SELECT {term(rule.head[0])} AS subject, {term(rule.head[1])} AS predicate, {term(rule.head[2])} AS object, max(least({scores})) AS confidence, '{rule.name}' AS rule
    FROM {', '.join(f'rf f{n}' for n in range(len(rule.body)))} WHERE {' AND '.join(where)} AND lower({term(rule.head[0])}) != lower({term(rule.head[2])}) GROUP BY 1, 2, 3"""


def _register(rule: rules.Rule) -> None:
    def run(spark, sf_dir):
        return rules.infer(rule_facts(spark, sf_dir, rule), rule, read(spark, sf_dir, RULE_TYPES))

    run.__name__ = f"rule_{rule.name.removesuffix('_v1')}_base"
    run.__doc__ = f"Inferences of {rule.name}."
    QUERIES[run.__name__], SQL[run.__name__] = run, rule_sql(rule)


for _rule in rules.BASE_RULES:
    _register(_rule)

COMPETITORS = next(r for r in rules.BASE_RULES if r.name == "competitor_detection_v1")


@query(rule_sql(COMPETITORS))
def rule_competitor(spark, sf_dir):
    return QUERIES["rule_competitor_detection_base"](spark, sf_dir)


_REST = rule_sql(COMPETITORS).replace("WITH rf AS (", "WITH rf AS (SELECT * FROM (", 1).replace("), ty AS", ") WHERE NOT (predicate = 'manufactures' AND object LIKE '%7')), ty AS", 1)


@query(f"SELECT subject, object FROM ({rule_sql(COMPETITORS)}) EXCEPT SELECT subject, object FROM ({_REST})")
def counterfactual_lost_inferences(spark, sf_dir):
    own = rule_facts(spark, sf_dir, COMPETITORS)
    removed = own.where("predicate = 'manufactures' AND object LIKE '%7'")
    return rules.lost_without(own, COMPETITORS, removed, read(spark, sf_dir, RULE_TYPES)).select("subject", "object")


_TOLD = "SELECT 'Part ' || p_partkey AS subject, CASE p_partkey % 3 WHEN 0 THEN 'a widget developed by ' || p_brand_label WHEN 1 THEN 'a division of ' || p_brand_label ELSE 'a ' || p_type END AS definition, 'stable' AS stability FROM (SELECT p_partkey, p_type, CASE WHEN p_size > 40 THEN 'Nobody' ELSE 'Brand ' || substr(p_brand, 7) END AS p_brand_label FROM part) AS t"
_LED = "SELECT 'supplier ' || s_suppkey AS subject, CASE s_suppkey % 2 WHEN 0 THEN 'founded' ELSE 'leader_of' END AS predicate, 'nation ' || s_nationkey AS object, 'volatile' AS stability FROM supplier"
_LABELS = "SELECT DISTINCT 'Brand ' || substr(p_brand, 7) AS label FROM part"


@query(f"""WITH t AS ({_TOLD}), r AS ({_LED}), k AS ({_LABELS}),
 o AS (SELECT subject, stability, CASE WHEN definition LIKE 'a division of %' THEN substr(definition, 15) WHEN definition LIKE '%developed by %' THEN substr(definition, 23) END AS owner, definition LIKE 'a division of %' AS part FROM t)
 SELECT subject, predicate, object, stability FROM r UNION ALL SELECT object, CASE predicate WHEN 'founded' THEN 'founded_by' ELSE 'led_by' END, subject, stability FROM r
 UNION ALL SELECT subject, 'is_a', definition, stability FROM t UNION ALL SELECT subject, 'owned_by', label, stability FROM o JOIN k ON owner = label UNION ALL SELECT subject, 'subsidiary_of', label, stability FROM o JOIN k ON owner = label WHERE part""")
def normalized_overlay(spark, sf_dir):
    return rules.normalized(read(spark, sf_dir, _LED), read(spark, sf_dir, _TOLD), read(spark, sf_dir, _LABELS))


_SOLD = "SELECT DISTINCT l_suppkey AS subject, l_returnflag AS predicate, l_partkey AS object FROM lineitem"


@query(f"WITH f AS ({_SOLD}), c AS (SELECT p_partkey AS object, p_type AS class FROM part UNION SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END FROM part), z AS (SELECT subject, predicate, count(*) AS n FROM f GROUP BY ALL), h AS (SELECT subject, predicate, class, count(*) AS k FROM f JOIN c USING (object) GROUP BY ALL) SELECT z.subject, z.predicate, min(class) AS class FROM z LEFT JOIN h ON h.subject = z.subject AND h.predicate = z.predicate AND k = n GROUP BY ALL")
def shared_object_class(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") > 25, "large").otherwise("small")
    classes = parts.select(F.col("p_partkey").alias("object"), F.col("p_type").alias("class")).union(parts.select("p_partkey", size)).distinct()
    return rules.shared_object_class(read(spark, sf_dir, _SOLD), classes)


_MADE = "SELECT DISTINCT p_type AS class, p_brand AS object, p_partkey AS subject FROM part"
_PATTERNS = "SELECT class || ':' || object AS pattern_id, count(*) AS support, round(count(*) / population, 6) AS confidence FROM m JOIN (SELECT class, count(*) AS population FROM m GROUP BY class) USING (class) GROUP BY class, object, population HAVING count(*) >= 2"


@query(f"WITH m AS ({_MADE}), p AS ({_PATTERNS}) SELECT row_number() OVER (ORDER BY confidence DESC, support DESC, pattern_id) AS rank, * FROM p ORDER BY rank LIMIT 200")
def pattern_ranking(spark, sf_dir):
    return rules.ranked_patterns(_mined(spark, sf_dir), "pattern_id")


def _mined(spark, sf_dir):
    own = read(spark, sf_dir, _MADE)
    members, facts = own.select("subject", "class"), own.select("subject", F.lit("made_by").alias("predicate"), "object")
    found = rules.class_implications(members, facts, 2, 0.0)
    return found.select(F.concat_ws(":", "class", "object").alias("pattern_id"), "support", "confidence")


@query(f"WITH m AS ({_MADE}), p AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, support DESC, pattern_id) AS r FROM ({_PATTERNS})) SELECT * FROM (SELECT subject AS entity, row_number() OVER (PARTITION BY subject ORDER BY r) AS rank, pattern_id FROM m JOIN p ON pattern_id = class || ':' || object AND r <= 200) WHERE rank <= 3")
def relevant_patterns(spark, sf_dir):
    own = read(spark, sf_dir, _MADE).select(F.concat_ws(":", "class", "object").alias("pattern_id"), F.col("subject").alias("entity"))
    return rules.relevant_patterns(rules.ranked_patterns(_mined(spark, sf_dir), "pattern_id"), own, own.select("entity"))


@query(f"WITH m AS (SELECT * FROM ({_MADE}) WHERE subject % 10 != 7), p AS ({_PATTERNS}) SELECT * FROM p")
def patterns_without_facts(spark, sf_dir):
    """Patterns after facts are taken out: only the counts of their classes change."""
    own = read(spark, sf_dir, _MADE)
    removed = own.where("subject % 10 = 7")
    less = lambda rows, sign: rows.groupBy("class", "object").agg((F.count("*") * sign).alias("k"))
    counts = less(own, 1).unionByName(less(removed, -1)).groupBy("class", "object").agg(F.sum("k").alias("support"))
    size = counts.groupBy("class").agg(F.sum("support").alias("population"))
    out = counts.where("support >= 2").join(size, "class")
    return out.select(F.concat_ws(":", "class", "object").alias("pattern_id"), "support", F.round(F.col("support") / F.col("population"), 6).alias("confidence"))
