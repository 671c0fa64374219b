"""What the library raises; it never prints or exits."""


class IngestError(RuntimeError):
    """An ingest, commit or compaction could not be completed."""


class StatsUnavailable(RuntimeError):
    """The table cannot be read just now: missing, unreadable or malformed."""


class ScrapeError(RuntimeError):
    """The remote service answered with something that cannot be used."""


class ScrapeCancelled(ScrapeError):
    """The caller asked to stop."""


class Cancelled(RuntimeError):
    """A run was stopped by its caller; what it would have committed is not committed."""
