"""Errors raised on the driver before a job runs."""


class SpecError(ValueError):
    """A job description, path or type that cannot be run as asked."""


class EmptyRangeError(SpecError):
    """Nothing in the source lies in the requested range."""
