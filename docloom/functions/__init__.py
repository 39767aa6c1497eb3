"""The expression language; importing this registers all operators."""

from . import collections, conversion, numbers, text  # noqa: F401
from .core import OPERATORS, Context, compile_expression

__all__ = ["OPERATORS", "Context", "compile_expression"]
