"""Checks of generated tests over tables that the given ones stand for."""

from __future__ import annotations

from ..operators import verify
from .files import over


@over("""+calls AS (SELECT * FROM test_calls),
o AS (SELECT test, name, arg_max(module, lineno) AS module FROM origins GROUP BY 1, 2),
s AS (SELECT * FROM signatures QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY lineno DESC) = 1),
j AS (SELECT c.test, c.name, o.module, c.n_args, s.required, s.total, s.flexible, s.name IS NULL AS missing FROM calls c JOIN o ON c.test = o.test AND c.name = o.name LEFT JOIN s ON s.module = o.module AND s.name = o.name WHERE o.module IN (SELECT module FROM modules))
SELECT test, name, module, CASE WHEN missing THEN 'missing' ELSE 'arity' END AS kind, CASE WHEN NOT missing THEN min(n_args) END AS n_args, required, total
FROM j WHERE missing OR (NOT flexible AND (n_args < required OR n_args > total)) GROUP BY test, name, module, missing, required, total
""", "test_calls", "origins", "modules", "signatures")  # fmt: skip
def call_arity(t):
    """JN-19: calls of imported names that their module lacks or that pass a wrong number of arguments."""
    return verify.arity_issues(*(t(n) for n in ("test_calls", "origins", "modules", "signatures")))


@over("""
SELECT 'o' || o_orderkey || '.o' AS path, 0::BIGINT AS ord, 'main' AS symbol, 'T' AS class FROM orders UNION ALL SELECT 'o' || o_orderkey || '.o', 1, 'f' || o_custkey, 't' FROM orders
UNION ALL SELECT 'o' || o_orderkey || '.o', 5, 'g' || o_orderkey, 'W' FROM orders WHERE o_orderkey % 2 = 0
""")
def listed_symbols(t):
    """EX-11: functions in symbol listings of object files."""
    return verify.text_symbols(t("objects"))
