"""A lakehouse table engine on PySpark."""

from .engine import Engine
from .errors import CommitConflict, LakeError, ValidationError

__all__ = ["CommitConflict", "Engine", "LakeError", "ValidationError"]
