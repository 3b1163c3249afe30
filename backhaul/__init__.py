"""Returns analytics on Spark: load, audit and analyse orders and their returns."""

from backhaul.warehouse import Warehouse

__all__ = ["Warehouse"]
