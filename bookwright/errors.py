"""What can go wrong, by kind."""


class UnsupportedFormat(ValueError):
    """A file of a format that isn't read, or that isn't what its name says."""


class EmbeddingUnavailable(RuntimeError):
    """The embedder can't be used; it affects every document."""


class EmbedderMismatch(ValueError):
    """A collection was built with another embedder or vector length."""


class RowSourceError(ValueError):
    """A row source or its mapping is wrong."""


class ExportError(RuntimeError):
    """A target refused an export or can't be reached."""
