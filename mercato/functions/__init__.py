"""Column-level rules shared by every analytic."""

from mercato.functions.rules import *  # noqa: F401,F403
