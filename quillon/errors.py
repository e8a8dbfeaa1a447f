"""Errors of the engine. Each names the condition; none is raised by Spark itself."""


class EngineError(Exception):
    """Any error that the engine finds before Spark runs."""


class ParseError(EngineError):
    """The text is not of the dialect."""


class ResolutionError(EngineError):
    """A name is unknown, or could mean several things."""


class TypeMismatch(EngineError):
    """An operator or function was given a type that it does not take."""


class CatalogError(EngineError):
    """A table or index exists already, does not exist, or has a bad name."""


class TransactionError(EngineError):
    """A transaction is not in the state for what was asked."""
