"""Errors of the public interface."""


class RecallError(Exception):
    """Base of all."""


class RetrievalError(RecallError):
    """A search cannot be answered, for instance because embedding the query failed."""


class ScopeError(RecallError):
    """A user or conversation does not exist, or its name is ambiguous."""


class ProvenanceError(RecallError):
    """A candidate names messages that do not exist or are not its user's."""


class ExtractionError(RecallError):
    """A provider's answer does not keep to the contract after all attempts, or the provider failed. category says how: invalid_json, schema_validation, timeout,
    rate_limit, connection or other."""

    def __init__(self, message: str, category: str = "other") -> None:
        super().__init__(message)
        self.category = category


class EmbeddingError(RetrievalError):
    """Vectors are missing, of another dimension, not finite or zero."""


class IndexError_(RetrievalError):
    """A stored index is missing, damaged or does not fit the request."""


class StaleIndexError(IndexError_):
    """A stored index is of another model than the one asked for."""


class SummaryError(RecallError):
    """A rolling summary cannot be made or its marker is not of its conversation."""


class ContextError(RecallError):
    """Targets of an extraction are missing, foreign or empty."""


class ConflictError(RecallError):
    """Another writer has changed the store since this batch was prepared; the caller may try again."""


class ResumeError(RecallError):
    """What is stored and what the checkpoint says do not agree, so nothing can be resumed safely."""


class ProviderError(RecallError):
    """A provider is not configured or not the one asked for."""
