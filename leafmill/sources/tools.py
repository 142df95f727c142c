"""What the host has: external programs for PDF pages and recognition, their presence, and the machine itself.

The programs are called by providers (see operators.recognition) on executors that have them; where one is missing, the
call fails and the failure stays with its page.
"""

from __future__ import annotations

import os
import platform
import re
import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The resolution that pages are rendered at, the packages that a host needs, and where spelling dictionaries lie.
DPI = 200
PACKAGES = [
    (1, "Tesseract OCR engine", "tesseract-ocr"), (2, "Tesseract English language data", "tesseract-ocr-eng"), (3, "Tesseract Vietnamese language data", "tesseract-ocr-vie"),
    (4, "PDF tools (poppler-utils)", "poppler-utils"), (5, "English spelling dictionary", "hunspell-en-us"), (6, "Vietnamese spelling dictionary", "hunspell-vi"),
]
DICTIONARIES = "/usr/share/hunspell"


class ToolMissing(RuntimeError):
    """A program that is not installed."""


def run(*command: str) -> str:
    """A program's output as text: faults in its UTF-8 as U+FFFD. A program that fails raises what it says."""
    try:
        got = subprocess.run(command, capture_output=True, check=False)
    except FileNotFoundError as e:
        raise ToolMissing(command[0]) from e
    if got.returncode:
        raise RuntimeError(f"{command[0]}: {got.stderr.decode('utf-8', 'replace').strip()}")
    return got.stdout.decode("utf-8", "replace")


class _File:
    """Bytes as a file of the host for the time of a call."""

    def __init__(self, content: bytes, suffix: str):
        self.content, self.suffix = content, suffix

    def __enter__(self) -> str:
        self.folder = tempfile.mkdtemp(prefix="leafmill-")
        path = Path(self.folder) / f"file{self.suffix}"
        path.write_bytes(self.content)
        return str(path)

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def page_count(content: bytes) -> int:
    """Pages of a PDF file; an error if the program names none."""
    with _File(content, ".pdf") as path:
        found = re.search(r"^Pages:\s*([0-9]+)\s*$", run("pdfinfo", path), re.M)
    if not found:
        raise RuntimeError("pdfinfo: no page count")
    return int(found[1])


def native_text(content: bytes, page: int) -> str:
    """The text of a PDF page, in its layout, without white space at the ends."""
    with _File(content, ".pdf") as path:
        return run("pdftotext", "-layout", "-f", str(page), "-l", str(page), path, "-").strip()


def rendered(content: bytes, page: int, dpi: int = DPI) -> bytes:
    """A PDF page as a PNG file: a Renderer."""
    with _File(content, ".pdf") as path:
        run("pdftoppm", "-r", str(dpi), "-png", "-singlefile", "-f", str(page), "-l", str(page), path, path)
        return Path(f"{path}.png").read_bytes()


def word_lines(image: bytes, lang: str) -> list[str]:
    """Recognised words of an image as tab-separated rows, the header among them (see operators.pages.parse_words)."""
    with _File(image, ".png") as path:
        return run("tesseract", path, "stdout", "-l", lang, "tsv").splitlines()


def installed_languages() -> list[str]:
    """Languages of the recognition engine; none if it cannot be asked."""
    try:
        lines = run("tesseract", "--list-langs").splitlines()[1:]
    except RuntimeError:
        return []
    return [x.strip() for x in lines if x.strip() not in ("", "osd")]


def dependencies(spark: SparkSession, dictionaries: str = DICTIONARIES) -> DataFrame:
    """no, name, package and installed of the packages that a host needs, for the host of the driver."""
    have = installed_languages()
    spelling = lambda base: all((Path(dictionaries) / f"{base}.{x}").exists() for x in ("aff", "dic"))
    state = [shutil.which("tesseract") is not None, "eng" in have, "vie" in have, shutil.which("pdftotext") is not None, spelling("en_US"), spelling("vi_VN")]
    rows = [(*p, ok) for p, ok in zip(PACKAGES, state, strict=True)]
    return spark.createDataFrame(rows, "no int, name string, package string, installed boolean")


def runtime_state(folder: str, name: str, target: str) -> str:
    """installed if the runtime's folder for a platform is there, else missing."""
    return "installed" if (Path(folder) / "runtime" / name / target).is_dir() else "missing"


def free_space(folder: str, mounts: dict[str, int]) -> int:
    """Free bytes of the mount with the longest path that the folder lies under; else the most free of all, 0 without any."""
    under = [m for m in mounts if Path(folder).is_relative_to(m)]
    return mounts[max(under, key=len)] if under else max(mounts.values(), default=0)


def mounts() -> dict[str, int]:
    """Free bytes of the mounts that can be asked."""
    out = {}
    table = Path("/proc/mounts")
    for line in table.read_text().splitlines() if table.exists() else []:
        point = line.split(" ")[1].replace("\\040", " ")
        try:
            out[point] = shutil.disk_usage(point).free
        except OSError:
            continue
    return out


def hardware(folder: str) -> dict[str, object]:
    """Platform, cores, memory and free space for a data folder."""
    ram = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else 0
    os_name = {"Darwin": "macos"}.get(platform.system(), platform.system().lower())
    arch = {"AMD64": "x86_64", "arm64": "aarch64"}.get(platform.machine(), platform.machine())
    return {"os": os_name, "arch": arch, "cpu_cores": os.cpu_count() or 1, "ram_bytes": ram, "disk_free_bytes": free_space(folder, mounts())}
