"""The registered queries."""

from riskloom.plans import extras, fits, more, rankings, tables  # noqa: F401
from riskloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
