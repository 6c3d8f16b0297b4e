"""Errors that callers may tell apart."""


class ResolutionError(Exception):
    """Base of all errors of this package."""


class DataQualityError(ResolutionError):
    """Input that can't be used."""


class NameParseError(ResolutionError):
    def __init__(self, raw: str, reason: str = "unparsable") -> None:
        super().__init__(f"{reason}: {raw!r}")
        self.raw, self.reason = raw, reason


class NPIConflictError(ResolutionError):
    def __init__(self, npis: list[str]) -> None:
        super().__init__(f"{len(npis)} npis in one cluster: {sorted(npis)}")
        self.npis = npis


class DatabaseError(ResolutionError):
    """A failed write to or read from a database."""
