"""Errors with a hint on what to do about them."""

from __future__ import annotations


class EngineError(Exception):
    hint = ""

    def __str__(self) -> str:
        said = super().__str__()
        return f"{said} ({self.hint})" if self.hint else said


class SourceError(EngineError):
    hint = "check the path and its suffix"


class ProviderError(EngineError):
    hint = "check the provider's name, key and model"


class ConfigError(EngineError):
    hint = "check the configuration"


class StoreError(EngineError):
    hint = "check that the folder is writable and shared"
