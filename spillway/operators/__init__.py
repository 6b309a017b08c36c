"""Operators: importing this package registers them all."""

from . import decode, limits, mask, ordered, parse, project  # noqa: F401
from .registry import ACTIONS, action  # noqa: F401
