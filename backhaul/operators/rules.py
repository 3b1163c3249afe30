"""What the constraints of the normalised tables are."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """A rule that one row can break by itself."""

    kind: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.kind} {self.column}"

    def broken(self) -> Column:
        """True or False, never NULL: like SQL, a CHECK accepts NULL."""
        value = F.col(self.column)
        if self.kind == "NOT NULL":
            return value.isNull()
        return F.coalesce(CHECKS[self.column](value), F.lit(False))


# What each CHECK forbids.
CHECKS = {
    "discount": lambda value: (value < 0) | (value > 1),
    "quantity": lambda value: value <= 0,
}


def _rules(not_null: Sequence[str], checks: Sequence[str] = ()) -> list[RowRule]:
    return ([RowRule("NOT NULL", c) for c in not_null] + [RowRule("CHECK", c) for c in checks])


ROW_RULES = {
    "customers": _rules(["customer_id"]),
    "products": _rules(["product_id", "category", "price", "discount"], ["discount"]),
    "orders": _rules(["order_id", "customer_id", "product_id", "order_date", "quantity",
                      "total_amount"], ["quantity"]),
    "returns": _rules(["return_id", "order_id"]),
}
UNIQUE = {"customers": ["customer_id"], "products": ["product_id"], "orders": ["order_id"],
          "returns": ["return_id", "order_id"]}
FOREIGN_KEYS = [("orders", "customer_id", "customers"), ("orders", "product_id", "products"),
                ("returns", "order_id", "orders")]
