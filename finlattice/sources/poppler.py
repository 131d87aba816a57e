"""Readers of PDF reports for documents.page_texts and page_images, by the Poppler tools where a worker has them."""

from __future__ import annotations

import subprocess

#: Seconds that a tool may take for one document.
PATIENCE = 300


def _run(content: bytes, *command: str) -> bytes:
    """What a tool writes when it reads the document from its standard input; a failure is an error with the tool's own words."""
    done = subprocess.run(command, input=bytes(content), capture_output=True, timeout=PATIENCE, check=False)
    if done.returncode:
        raise ValueError(f"{command[0]}: {done.stderr.decode(errors='replace').strip()[:500]}")
    return done.stdout


def texts(content: bytes) -> list[str]:
    """The text layer of each page, in order ("" where a page has none)."""
    pages = _run(content, "pdftotext", "-layout", "-enc", "UTF-8", "-", "-").decode(errors="replace").split("\f")
    return pages[:-1] if pages and not pages[-1].strip() else pages


def image(content: bytes, page: int, dpi: int = 150) -> bytes:
    """One page as a PNG."""
    return _run(content, "pdftoppm", "-png", "-r", str(dpi), "-f", str(page), "-l", str(page), "-")


def info(content: bytes) -> str:
    """The report's description, from which files.page_count reads the number of pages."""
    return _run(content, "pdfinfo", "-").decode(errors="replace")
