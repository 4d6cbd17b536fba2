"""Errors that callers can tell apart."""


class RiskloomError(Exception):
    """Base of all."""


class ValidationError(RiskloomError, ValueError):
    """Input or specification that cannot be used."""


class FittingError(RiskloomError):
    """A fit that cannot go on."""


class LinearAlgebraError(FittingError):
    """A singular system."""


class SerializationError(RiskloomError):
    """A stored model that cannot be read or written."""
