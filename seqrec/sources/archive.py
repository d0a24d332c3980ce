"""Fetching and unpacking a ratings archive on the driver, before any Spark job."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from pathlib import Path


def fetch(url: str, target: str | Path, force: bool = False) -> Path:
    """Downloads ``url``; an existing file is kept unless ``force``."""
    target = Path(target)
    if force or not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out)
        part.replace(target)
    return target


def unpack(archive: str | Path, folder: str | Path, name: str, force: bool = False) -> Path:
    """Unpacks a zip whose folder ``name`` holds ratings.csv; members must stay inside ``folder``."""
    folder = Path(folder)
    ratings = folder / name / "ratings.csv"
    if ratings.exists() and not force:
        return ratings
    root = folder.resolve()
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():
            if not (root / member).resolve().is_relative_to(root):
                raise ValueError(f"{member} lies outside the folder")
        if f"{name}/ratings.csv" not in z.namelist():
            raise ValueError("the archive has no ratings.csv")
        z.extractall(root)
    return ratings


def fetch_and_unpack(url: str, folder: str | Path, name: str, force: bool = False) -> Path:
    return unpack(fetch(url, Path(folder) / f"{name}.zip", force), folder, name, force)
