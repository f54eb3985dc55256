"""Queries of the library's operators over the driver's tables, with their SQL."""

from scorewright.plans import boards, coverage, exams, files, grading, labels, rendering, studies

_MODULES = (grading, boards, studies, exams, files, labels, rendering, coverage)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in m.ORACLE_SQL.items()}
