"""Readers of page images: OCR and transcribers, with probes of what a machine offers. All back ends are optional; no probe raises."""

from __future__ import annotations

import base64
import importlib.util
import io
import os
import shutil
import subprocess
from collections.abc import Callable
from functools import lru_cache

from ..errors import AdapterUnavailableError, MultimodalUnavailableError, OcrUnavailableError
from ..operators.repair import MultimodalConfig, resolve_model

# OCR language and resolution, and the environment variables that hold providers' keys.
OCR_LANGUAGE, OCR_DPI = "sin", 300
API_KEYS = {"gemini": ("GEMINI_API_KEY", "GOOGLE_API_KEY"), "openai": ("OPENAI_API_KEY",), "claude": ("ANTHROPIC_API_KEY",)}
RASTERISER = "PATRAFLOW_RASTERISER"

#: PNG bytes -> text.
Transcriber = Callable[[bytes], str]


def has_module(name: str) -> bool:
    try:
        return importlib.util.find_spec(name) is not None
    except (ImportError, ValueError):
        return False


@lru_cache(1)
def tesseract_command() -> str | None:
    """The command that TESSERACT_CMD names, else the one on the path."""
    named = os.environ.get("TESSERACT_CMD")
    return named if named and os.path.isfile(named) else shutil.which("tesseract")


@lru_cache(1)
def tesseract_languages() -> frozenset[str]:
    if (command := tesseract_command()) is None:
        return frozenset()
    try:
        out = subprocess.run([command, "--list-langs"], capture_output=True, text=True, timeout=20).stdout
    except (OSError, subprocess.SubprocessError):
        return frozenset()
    return frozenset(out.split("\n")[1:]) - {""}


def ocr_available(language: str = OCR_LANGUAGE) -> bool:
    return language in tesseract_languages() and has_module("pytesseract")


def poppler_available() -> bool:
    return shutil.which("pdftoppm") is not None


def api_key(provider: str) -> str | None:
    """Read anew each time, so that a key set later is seen."""
    return next((v for k in API_KEYS.get(provider, ()) if (v := os.environ.get(k))), None)


def describe_availability() -> dict[str, str]:
    """What is missing for each reader; an empty text where nothing is."""
    ocr = "" if ocr_available() else "no tesseract" if tesseract_command() is None else f"no language {OCR_LANGUAGE}" if OCR_LANGUAGE not in tesseract_languages() else "no pytesseract"
    return {"ocr": ocr} | {p: "" if api_key(p) else f"none of {', '.join(k)} is set" for p, k in API_KEYS.items()}


def rasterise_page(content: bytes, page: int, dpi: int = OCR_DPI) -> bytes:
    """PNG of a PDF's page (from 0), by PyMuPDF, or by pdf2image if PATRAFLOW_RASTERISER says so."""
    if os.environ.get(RASTERISER) == "pdf2image":
        if not has_module("pdf2image"):
            raise AdapterUnavailableError("pdf2image is not installed")
        from pdf2image import convert_from_bytes

        out = io.BytesIO()
        convert_from_bytes(content, dpi=dpi, first_page=page + 1, last_page=page + 1)[0].save(out, "PNG")
        return out.getvalue()
    if not has_module("pymupdf"):
        raise AdapterUnavailableError("pymupdf is not installed")
    import pymupdf

    return pymupdf.open(stream=content, filetype="pdf")[page].get_pixmap(dpi=dpi).tobytes("png")


def ocr_reader(language: str = OCR_LANGUAGE):
    """A reader for operators.repair: OCR of the page's image."""

    def read(doc, page, image):
        if not ocr_available(language):
            raise OcrUnavailableError(f"no OCR for {language}")
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(image)), lang=language)

    return read


def transcriber_reader(config: MultimodalConfig, clients: dict[str, Callable[[str | None], Transcriber]], model: str | None = None, defaults: dict[str, str] | None = None):
    """A reader for operators.repair: the page's image through the provider's client, made by clients[provider](model) in the worker."""
    if config.provider not in clients:
        raise MultimodalUnavailableError(f"no client for {config.provider}")
    make, name = clients[config.provider], resolve_model(config, model, defaults)
    held: list[Transcriber] = []

    def read(doc, page, image):
        if not held:
            held.append(make(name))
        return held[0](image) or ""

    return read


def png_to_base64(png: bytes) -> str:
    return base64.b64encode(png).decode()


def analyse_layout(path: str):
    """Layout analysis is not part of the engine."""
    raise NotImplementedError("layout analysis")


def char_fonts(content: bytes):
    """(character, font with its subset prefix) of a PDF, by pdfplumber."""
    if not has_module("pdfplumber"):
        raise AdapterUnavailableError("pdfplumber is not installed")
    import pdfplumber

    for page in pdfplumber.open(io.BytesIO(content)).pages:
        yield from ((c["text"], c["fontname"]) for c in page.chars)
