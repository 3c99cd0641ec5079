"""Errors that the engine raises on purpose; faults of single documents are columns instead."""

from __future__ import annotations


class PatraflowError(Exception):
    """Base of the engine's errors."""


class UnsupportedFormatError(PatraflowError):
    """Neither a PDF nor a known OOXML container."""


class UnmappedLegacyFontError(PatraflowError):
    """A legacy font without a conversion table; a payload for reports, never raised while extracting."""

    def __init__(self, font_name: str):
        self.font_name = font_name
        super().__init__(f"the legacy font {font_name!r} has no conversion table; its text is unchanged")


class AdapterUnavailableError(PatraflowError):
    """An optional backend is not installed."""


class ExtractionFailedError(PatraflowError):
    """Every backend failed for a document."""


class OcrUnavailableError(PatraflowError):
    """No OCR engine, or none for the language."""


class RuleEngineUnavailableError(PatraflowError):
    """Kept for callers that catch it; the rules are column expressions here."""


class MultimodalUnavailableError(PatraflowError):
    """The provider has no key or no client."""


class BudgetExceededError(PatraflowError):
    """A document needs more pages transcribed than allowed."""

    def __init__(self, needed: int, allowed: int):
        self.needed, self.allowed = needed, allowed
        super().__init__(f"{needed} pages need transcription, the limit is {allowed}")
