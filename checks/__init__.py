from checks.registry import ORACLE, QUERIES
from checks import budget_queries, category_queries, ledger_queries, maintain_queries, report_queries, statement_queries  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
