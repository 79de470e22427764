"""What can go wrong, by kind."""

from __future__ import annotations


class TesseraError(Exception):
    """Any error that a statement reports."""


class InternalError(TesseraError):
    """A state that should not be."""


class ValueFault(TesseraError):
    """A value, name or type that doesn't fit."""


class ReadOnlyError(TesseraError):
    """A write in a read-only transaction."""


class SerializationError(TesseraError):
    """A write that a concurrent transaction has got ahead of; the transaction can be tried again."""


class ParseError(TesseraError):
    """Text that is no statement."""


class AlreadyExistsError(TesseraError):
    """A table, index, column or key that is there already."""


class UnimplementedError(TesseraError):
    """A statement that is understood and has no meaning here."""
