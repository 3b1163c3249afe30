"""All rules of all tables in one pass: every row is read once and meets the others of its keys.

A row of a table is turned into an entry for each key it carries (order, customer, product, return)
and one for the rules it breaks by itself. One aggregation by kind and key then knows how often the key
is in its own table and in the table that refers to it, which tells repeated keys and orphans, and
one more adds that up to a single row. Entries are counted in their task first, so a key with a
third of all rows stays cheap, and so do the few combinations of broken rules.

A task holds an entry for every key of its part of a table, so entries are narrow: kind and key are
one text, beside two whole numbers. Staging, which no rule compares with another table by key, has an
aggregation of its own, by product; the first row of an order is found where its rows are together.

Two categories of a product are told apart by 96 bits of hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.operators.load import load_order, parse_date
from backhaul.operators.rules import FOREIGN_KEYS, ROW_RULES, UNIQUE
from backhaul.schemas import INGEST_SEQ, MONEY, ORDER_GROUP

#: By table: its keys, the own one first.
KEYS = {
    "customers": {"customer": "customer_id"},
    "products": {"product": "product_id"},
    "orders": {"order": "order_id", "customer": "customer_id", "product": "product_id"},
    "returns": {"return": "return_id", "order": "order_id"},
}
RULE = "!"
#: The entry of all rows of an order but its first.
COPY = "+"
KINDS = ("order", "customer", "product", "return", RULE)
DATES = ("order_date", "delivered_date", "request_date")
LATE = "delivered before ordered"
#: The entry of the orders' amounts.
AMOUNTS = "$"
#: Hundredths that make one large part of an amount, see ``_entries``.
LARGE = 10_000_000


def _broken(table: str) -> dict[str, Column]:
    """What a row of the table can break by itself, by name."""
    rules = {r.name: r.broken() for r in ROW_RULES.get(table, ())}
    if table == "staging":
        for c in DATES:
            rules[f"DATE {c}"] = (F.col(c).isNotNull() & (F.trim(c) != "")
                                  & parse_date(c).isNull())
    if table == "orders":
        rules[LATE] = F.coalesce(F.col("delivered_date") < F.col("order_date"), F.lit(False))
    return rules


def _named(kind: str, key: Column) -> Column:
    """Kind and key as one text; a key that is NULL leaves the first letter of the kind."""
    letter = kind[0]
    return F.coalesce(F.concat(F.lit(f"{letter}="), key.cast("string")), F.lit(letter))


def _rules_entry(table: str, broken: list[Column]) -> Column:
    """The text for all rules that a row breaks: a bit for each of the table. A set of entries that
    every row has needs no sorting out by row, which costs more than the aggregation of this one."""
    bits = [F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(broken)]
    return _named(RULE, F.concat(F.lit(f"{table} "), reduce(Column.__add__, bits).cast("string")))


def _entries(table: str, rows: DataFrame, amounts: bool) -> DataFrame:
    """``amounts``: those of orders are added as well, as hundredths in two whole numbers."""
    def entry(name: Column, own: Column, refs: Column) -> Column:
        return F.struct(name.alias("entry"), own.cast("long").alias("own"),
                        refs.cast("long").alias("refs"))

    one, none = F.lit(1), F.lit(0)
    own_kind = next(iter(KEYS[table]))
    entries = [entry(_named(kind, F.col(column)), *((one, none) if kind == own_kind else
                                                   (none, one)))
               for kind, column in KEYS[table].items()]
    entries.append(entry(_rules_entry(table, list(_broken(table).values())), one, none))
    if table == "orders" and amounts:
        hundredths = (F.col("total_amount").cast(MONEY) * 100).cast("long")
        rest = hundredths % LARGE
        entries.append(entry(F.lit(AMOUNTS), rest, (hundredths - rest) / LARGE))
    return rows.select(F.inline(F.array(*entries)))


def _counted(tables: dict[str, DataFrame], amounts: bool = False) -> DataFrame:
    """By entry: rows of the key's own table, rows of the table that refers to it."""
    entries = reduce(DataFrame.unionByName,
                     [_entries(name, rows, amounts) for name, rows in tables.items()])
    return entries.groupBy("entry").agg(F.sum("own").alias("own"), F.sum("refs").alias("refs"))


def _rows_in(table: str, kind: str) -> Column:
    """Rows of a key in a table, of what ``_counted`` returns."""
    return F.col("own" if kind == RULE or next(iter(KEYS[table])) == kind else "refs")


def _is(kind: str) -> Column:
    return F.ascii("entry") == ord(kind[0])


def _has_key() -> Column:
    return F.octet_length("entry") > 1


def _key() -> Column:
    return F.when(_has_key(), F.substr("entry", F.lit(3)))


def per_key(tables: dict[str, DataFrame]) -> DataFrame:
    """By kind and key: rows of every table that has keys of the kind."""
    kind = F.coalesce(*[F.when(_is(k), k) for k in KINDS])
    counts = [F.coalesce(*[F.when(_is(k), _rows_in(name, k)) for k in keys], F.lit(0))
              .alias(f"in_{name}") for name, keys in KEYS.items()]
    return _counted(tables).select(kind.alias("kind"), _key().alias("key"), *counts)


def per_product(staging: DataFrame) -> DataFrame:
    """By entry: rows of staging and whether there is more than one category, for its products;
    orders, amounts and first rows' amounts, for the others.

    Where the rows of an order are together (``ORDER_GROUP``), its first row is marked there and the
    orders are not moved; else each is an entry, aggregated with its first row.
    """
    together = ORDER_GROUP in staging.columns
    known = F.col("category").isNotNull()
    rows = staging.select(
        "order_id", "product_id", F.col("total_amount").cast("decimal(38,2)").alias("amount"),
        F.when(known, F.xxhash64("category")).alias("hash_a"),
        F.when(known, F.hash("category")).alias("hash_b"),
        *[broken.alias(name) for name, broken in _broken("staging").items()],
        INGEST_SEQ, *([ORDER_GROUP] if together else []))
    if together:
        place = F.row_number().over(load_order(rows))
        rows = rows.withColumn("copy", place > 1)
        order = F.when(F.col("copy"), F.lit(COPY)).otherwise(_named("order", F.when(
            F.col("order_id").isNotNull(), F.lit(""))))
    else:
        order = _named("order", F.col("order_id"))

    nothing = {"amount": "decimal(38,2)", "hash_a": "long", "hash_b": "int",
               **({} if together else {INGEST_SEQ: rows.schema[INGEST_SEQ].dataType})}

    def entry(name: Column, *columns: str) -> Column:
        return F.struct(name.alias("entry"), *[
            (F.col(c) if c in columns else F.lit(None).cast(t)).alias(c)
            for c, t in nothing.items()])

    entries = rows.select(F.inline(F.array(
        entry(_named("product", F.col("product_id")), "hash_a", "hash_b"),
        entry(order, "amount", INGEST_SEQ),
        entry(_rules_entry("staging", [F.col(f"`{name}`") for name in _broken("staging")])))))
    differ = [F.min(h) != F.max(h) for h in ("hash_a", "hash_b")]
    found = entries.groupBy("entry").agg(
        F.count(F.lit(1)).alias("in_staging"), F.sum("amount").alias("staging_amount"),
        F.coalesce(differ[0] | differ[1], F.lit(False)).alias("several_categories"),
        *([] if together else [F.min_by("amount", INGEST_SEQ).alias("first_amount")]))
    if together:
        found = found.withColumn("first_amount", F.when(_is("order"), F.col("staging_amount")))
    named = _is("order") & _has_key()
    return found.withColumn("staging_orders", F.when(
        named, F.col("in_staging") if together else F.lit(1).cast("long")))


def violation(table: str, kind: str, column: str) -> str:
    """The column of ``audit`` that counts what breaks a constraint."""
    return f"{table} {kind} {column}"


def audit(customers: DataFrame, products: DataFrame, orders: DataFrame, returns: DataFrame,
          staging: DataFrame | None = None) -> DataFrame:
    """One row with everything the reports need; see the names below. What is measured on staging,
    and the orders' revenue beside it, is there if staging is given."""
    tables = {"customers": customers, "products": products, "orders": orders, "returns": returns}
    known = F.col("known")

    def of(kind: str) -> Column:
        return F.col("letter") == ord(kind[0])

    def total(value: Column, kind: str, condition: Column | None = None) -> Column:
        return F.sum(F.when(of(kind) if condition is None else of(kind) & condition, value))

    def number(value: Column, kind: str, condition: Column | None = None) -> Column:
        return F.coalesce(total(value, kind, condition), F.lit(0))

    def broken(value: Column, table: str, rule: str) -> Column:
        bit = F.lit(1 << list(_broken(table)).index(rule))
        return number(value, RULE, (F.col("table") == table) & (
            F.col("bits").bitwiseAND(bit) > 0))

    here, returned = _rows_in("orders", "order"), _rows_in("returns", "order")
    results = {f"{name}_count": number(_rows_in(name, next(iter(keys))), next(iter(keys)))
               for name, keys in KEYS.items()}
    results |= {
        "duplicate_order_count": F.count_if(of("order") & (here > 1)),
        # rows of the join of orders with returns
        "joined_orders": number(here * F.greatest(returned, F.lit(1)), "order", known),
        "joined_returns": number(here * returned, "order", known),
    }
    for name in KEYS:
        for rule in _broken(name):
            results[f"{name} {rule}"] = broken(_rows_in(name, RULE), name, rule)
    kind_of = {(t, c): kind for t, keys in KEYS.items() for kind, c in keys.items()}
    for name, columns in UNIQUE.items():
        for c in columns:
            kind = kind_of[name, c]
            results[violation(name, "UNIQUE", c)] = F.count_if(
                of(kind) & known & (_rows_in(name, kind) > 1))
    for child, c, parent in FOREIGN_KEYS:
        kind = kind_of[child, c]
        lost = _rows_in(parent, kind) == 0
        results[violation(child, "FOREIGN KEY", c)] = number(_rows_in(child, kind), kind,
                                                             known & lost)
        # a row without the key has no parent either
        results[f"{child} orphans {c}"] = number(_rows_in(child, kind), kind, ~known | lost)
    counted = _counted(tables, amounts=staging is not None)
    if staging is not None:
        counted = counted.unionByName(per_product(staging), allowMissingColumns=True)
        large, rest = (total(F.col(c), AMOUNTS).cast("decimal(20,0)")
                       for c in ("refs", "own"))
        results |= {
            "staging_count": number(F.col("in_staging"), "product"),
            "staging_unique_orders": F.coalesce(F.sum("staging_orders"), F.lit(0)),
            "staging_revenue": F.sum("staging_amount"),
            "first_revenue": F.sum("first_amount"),
            "orders_revenue": ((large * LARGE + rest) / 100).cast("decimal(38,2)"),
            "conflicting_products": F.count_if(of("product") & F.col("several_categories")),
            "staging_products": F.count_if(of("product") & known & (F.col("in_staging") > 0)),
            **{f"staging {rule}": broken(F.col("in_staging"), "staging", rule)
               for rule in _broken("staging")},
        }
    # worked out once for a key, not in every result
    marked = counted.select(
        "*", F.ascii("entry").alias("letter"), _has_key().alias("known"),
        F.when(_is(RULE), F.substring_index(_key(), " ", 1)).alias("table"),
        F.when(_is(RULE), F.substring_index(_key(), " ", -1).try_cast("int")).alias("bits"))
    return marked.agg(*[value.alias(name) for name, value in results.items()])
