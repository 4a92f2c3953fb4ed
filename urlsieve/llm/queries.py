"""All queries of this subpackage and their SQL."""

from . import collapse, heavy, langid, leakage, lookalike, packing, seen

MODULES = (seen, lookalike, heavy, collapse, packing, leakage, langid)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
