"""cadenza — verse-corpus analytics expressed as Spark DataFrame plans.

Every public operator is a function ``f(df, ...) -> DataFrame`` built from
Spark SQL expressions, joins, windows and aggregations.  Language-specific
rules enter only through :mod:`cadenza.profiles`.
"""

__all__ = ["session", "profiles"]
