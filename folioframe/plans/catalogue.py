"""All registered queries: importing the modules fills the registry."""

from folioframe.plans import compare, files, layout, pages, privacy, review, search, tables  # noqa: F401
from folioframe.plans.registry import ORACLES, QUERIES  # noqa: F401
