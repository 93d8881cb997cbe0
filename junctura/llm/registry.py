"""The queries of this subpackage and the SQL that some of them can be held against."""

from . import classlm, decontam, exact, licenses, mixing, neardup, pages, repeats, runs, tokencount, toxicity, urls

MODULES = (classlm, decontam, exact, licenses, mixing, neardup, pages, repeats, runs, tokencount, toxicity, urls)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
