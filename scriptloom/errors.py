"""Errors on the driver; on executors their text goes to an `error` column."""


class ScriptloomError(Exception):
    """Base of all expected failures."""


class ConfigurationError(ScriptloomError):
    """Settings or inputs that can't work."""


class MediaError(ScriptloomError):
    """Sources without anything to analyze."""


class ExternalToolError(ScriptloomError):
    """A decoder failed."""


class ModelOutputError(ScriptloomError):
    """A model's reply can't be used."""


class BackendError(ScriptloomError):
    """A model server failed."""
