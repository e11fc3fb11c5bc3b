"""Exceptions, by the moment at which a mistake can be seen."""


class LaminaError(Exception):
    """Root of all."""


class CompileError(LaminaError):
    """A script or a pipeline that cannot be laid out."""


class SqlSyntaxError(CompileError, SyntaxError):
    """Text that is no statement."""


class SchemaError(LaminaError, ValueError):
    """Columns that are missing, doubled or of the wrong type."""


class ValidationError(CompileError, ValueError):
    """An extension's rules that its use does not meet."""


class RunError(LaminaError, RuntimeError):
    """What fails while a pipeline runs."""
