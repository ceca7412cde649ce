"""Errors of the engine; each may carry suggestions for the caller."""

from __future__ import annotations


class EngineError(Exception):
    """Root of all errors."""

    def __init__(self, message: str, suggestions: tuple[str, ...] = ()):
        super().__init__(message)
        self.suggestions = tuple(suggestions)


class ConfigError(EngineError):
    """A setting of the engine that cannot be right."""


class LimitConfigError(ConfigError):
    """Limits that are no whole numbers from 1, or that contradict each other."""


class KeyConfigError(ConfigError):
    """A key over columns that are not there."""


class RelationshipConfigError(ConfigError):
    """Two relationships of one table with one name."""


class EmbeddingError(ConfigError):
    """An embedding callback whose vectors do not fit the texts or each other."""


class ToolConfigError(ConfigError):
    """A custom tool without a description, of an unknown tier, or with a name that is taken."""


class SourceError(EngineError):
    """A source of tables that cannot be read as it is described."""


class UnknownNameError(EngineError):
    """A name that is not there, or that is hidden."""


class UnknownTableError(UnknownNameError):
    pass


class UnknownColumnError(UnknownNameError):
    pass


class UnknownRelationshipError(UnknownNameError):
    pass


class UnknownConceptError(UnknownNameError):
    pass


class UnknownMeasureError(UnknownNameError):
    pass


class UnknownToolError(UnknownNameError):
    pass


class SensitiveColumnError(EngineError):
    """A column that may be described but not used."""


class QuerySpecError(EngineError):
    """A request of the wrong shape."""


class ArgumentError(QuerySpecError):
    """An argument of a tool that is missing, unknown or of the wrong type."""


class KindError(QuerySpecError):
    """An operator, function or value that does not fit a column's kind."""


class NotSearchableError(QuerySpecError):
    """A search in a table or column that is not searchable."""


class LimitExceededError(EngineError):
    """A request over a configured limit."""


class ExecutionError(EngineError):
    """Spark could not run a plan; the cause is not shown."""


class MetadataError(EngineError):
    """A metadata file that is malformed, or that does not fit the catalog."""


class MetadataConflictError(MetadataError):
    """A metadata file that has changed on disk since it was loaded."""


class ReadOnlyError(EngineError):
    """An edit where edits are not allowed."""
