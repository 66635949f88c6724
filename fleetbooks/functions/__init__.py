"""Column expressions: predicates, parsing, dates, money and display labels."""

from fleetbooks.functions import dates, labels, money, predicates, text

__all__ = ["dates", "labels", "money", "predicates", "text"]
