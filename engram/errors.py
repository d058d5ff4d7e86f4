"""Errors of the engine."""


class EngineError(Exception):
    """Anything a statement refuses or fails with."""


class SyntaxProblem(EngineError):
    """Text that is no statement of the dialect."""
