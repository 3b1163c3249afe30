"""Risk labels by return rate."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH = 0.50
MODERATE = 0.20

NO_RETURNS = "No Returns"
RISK_LABELS = ("High Risk", "Moderate Risk", "Low Risk")
RETURN_RISK_LABELS = ("High Return Risk", "Moderate Return Risk", "Low Return Risk")


def risk(rate: Column, high: float = HIGH, moderate: float = MODERATE,
         labels: tuple[str, str, str] = RISK_LABELS) -> Column:
    """Three bands with inclusive lower bounds; NULL rates fall in the lowest."""
    return (F.when(rate >= high, F.lit(labels[0]))
            .when(rate >= moderate, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def behavior(rate: Column, returns: Column, high: float = HIGH,
             moderate: float = MODERATE) -> Column:
    """Risk bands plus a label of their own for customers who never returned anything."""
    return F.when(returns == 0, F.lit(NO_RETURNS)).otherwise(risk(rate, high, moderate))
