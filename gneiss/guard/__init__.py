"""The guard of user SQL: a lexer, a parser, the rules, and rendering for Spark."""

from gneiss.guard.rules import Rejected, ValidatedQuery, describe, execute, validate_sql

__all__ = ["Rejected", "ValidatedQuery", "describe", "execute", "validate_sql"]
