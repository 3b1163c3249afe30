"""Keys, NOT NULL, CHECK and foreign keys of the normalised tables.

Spark does not enforce them. ``constraint_report`` counts violations, ``enforce`` moves offending
rows of all four tables aside, parents before children, and ``require_valid`` fails the job the
way a rejected insert would.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.operators.audit import audit, violation
from backhaul.operators.rules import FOREIGN_KEYS, ROW_RULES, UNIQUE
from backhaul.plans.shared import stored

#: Keys of a broken rule that are sent to every task.
MOST_BROKEN_KEYS = 1_000_000


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent. A NULL key has no parent either."""
    return child.join(parent.select(key), key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Number of orphans. Child rows are counted per key first: the join then sees each key
    once, whatever share of the rows it has."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return orphans(per_key, parent, key).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias(name))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def constraint_report(customers: DataFrame, products: DataFrame, orders: DataFrame,
                      returns: DataFrame) -> DataFrame:
    """One row per constraint: table_name, kind, column_name, violations.

    UNIQUE counts repeated non-NULL values, FOREIGN KEY non-NULL values without a parent. All are
    counted in one pass over the tables.
    """
    constraints = [(table, rule.kind, rule.column) for table, rules in ROW_RULES.items()
                   for rule in rules]
    constraints += [(table, "UNIQUE", c) for table, columns in UNIQUE.items() for c in columns]
    constraints += [(child, "FOREIGN KEY", c) for child, c, _ in FOREIGN_KEYS]
    return audit(customers, products, orders, returns).select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(kind).alias("kind"),
                 F.lit(c).alias("column_name"),
                 F.col(f"`{violation(table, kind, c)}`").alias("violations"))
        for table, kind, c in constraints])))


def split_valid(table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every row rule, and the others with the ``violations`` they break."""
    broken = F.array_compact(F.array(*[
        F.when(rule.broken(), F.lit(rule.name)) for rule in ROW_RULES[table]
    ]))
    marked = rows.withColumn("violations", broken)
    return (marked.filter(F.size("violations") == 0).drop("violations"),
            marked.filter(F.size("violations") > 0))


def require_valid(table: str, rows: DataFrame) -> DataFrame:
    """The same rows, failing the job when one breaks a row rule."""
    for rule in ROW_RULES[table]:
        rows = rows.filter(F.assert_true(~rule.broken(), f"{table}: {rule.name}").isNull())
    return rows


def _to_look_up(keys: DataFrame) -> DataFrame:
    """Keys whose rows go, stored; they are sent to every task, so the rows stay where they are,
    unless they are too many."""
    keys = stored(keys, "broken-keys")
    return F.broadcast(keys) if keys.count() <= MOST_BROKEN_KEYS else keys


def enforce(customers: DataFrame, products: DataFrame, orders: DataFrame, returns: DataFrame
            ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The four tables with every constraint kept, and the rows set aside, by table.

    A row set aside names in ``violations`` the first kind of rule it breaks: its own rules, a
    repeated key (all its rows go), a parent that does not exist or was set aside itself. Broken
    keys are found among the keys alone and stored at once; the rows only look them up.
    """
    kept: dict[str, DataFrame] = {}
    aside: dict[str, DataFrame] = {}
    for name, rows in {"customers": customers, "products": products, "orders": orders,
                       "returns": returns}.items():
        columns = rows.columns
        good, bad = split_valid(name, rows)

        def move(broken: DataFrame, label: str, bad=bad, columns=columns) -> DataFrame:
            return bad.unionByName(broken.select(*columns)
                                   .withColumn("violations", F.array(F.lit(label))))

        for key in UNIQUE[name]:
            twice = _to_look_up(repeated_keys(good, key).select(key))
            bad = move(good.join(twice, key, "left_semi"), f"UNIQUE {key}", bad)
            good = good.join(twice, key, "left_anti")
        for child, key, parent in FOREIGN_KEYS:
            if child == name:
                lost = _to_look_up(orphans(good.select(key).distinct(), kept[parent], key)
                                   .withColumnRenamed(key, "_lost"))
                without_parent = F.col(key).eqNullSafe(F.col("_lost"))
                bad = move(good.join(lost, without_parent, "left_semi"), f"FOREIGN KEY {key}", bad)
                good = good.join(lost, without_parent, "left_anti")
        kept[name], aside[name] = good.select(*columns), bad
    return kept, aside
