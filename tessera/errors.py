"""Typed errors of the engine."""


class TesseraError(Exception):
    """Base of all errors raised here."""


class ParseError(TesseraError):
    """A statement outside the dialect."""


class AnalysisError(TesseraError):
    """Unknown or ambiguous names, wrong types, joins that leave a table unconnected."""


class SchemaError(TesseraError):
    """A malformed schema text or rows that do not fit a table."""


class TransactionAborted(TesseraError):
    """Another transaction changed a table first."""
