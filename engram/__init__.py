"""A PySpark-native analytics engine with an associative memory layer."""

from .engine import Engine, Result
from .errors import EngineError

__all__ = ["Engine", "EngineError", "Result"]
__version__ = "0.1.0"
