"""Column expressions and fixed values."""
from . import constants, patterns, text  # noqa: F401
