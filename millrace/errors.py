"""Errors of the engine."""

from __future__ import annotations


class MillraceError(RuntimeError):
    """Misuse of the API: unknown formats, bad options."""


class ParseError(Exception):
    """Anything that goes wrong while reading or shaping data."""


class XmlError(ParseError):
    """Malformed XML."""


class PlanError(ParseError):
    """A plan that can't be carried out: bad filters, types, strict casts that fail."""


class MergeError(ParseError):
    """Parts whose schemas don't fit together."""


class ParserError(ParseError):
    """Input that a format doesn't allow."""


#: Begins the message of an error raised inside a query, so that unwrapped() finds it.
MARK = "millrace:"
_KINDS = {k.__name__: k for k in (ParseError, XmlError, PlanError, MergeError, ParserError)}


def raised(kind: type[ParseError], message):
    """A column that raises the error when it is evaluated. message: a string column."""
    from pyspark.sql import functions as F

    return F.raise_error(F.concat(F.lit(f"{MARK}{kind.__name__}:"), message))


def unwrapped(error: Exception) -> Exception:
    """The engine's own error behind a failed Spark action, or the error itself."""
    text = str(error)
    at = text.find(MARK)
    if at < 0:
        return error
    name, _, rest = text[at + len(MARK) :].partition(":")
    return _KINDS[name](rest.split("\n")[0].split(" SQLSTATE")[0].strip()) if name in _KINDS else error
