"""plainframe: a small closed grammar of table steps, compiled to Spark DataFrame plans."""

from .api import run
from .plans.diagnostics import PlainError
from .show import explain_sql, show_as, show_steps
from .sources.tables import example_table
from .verbs import *  # noqa: F403
from .verbs import __all__ as _verbs

__all__ = ["PlainError", "example_table", "explain_sql", "run", "show_as", "show_steps", *_verbs]
