"""Path and name spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_form(path: Column) -> Column:
    r"""One spelling per file: ``/`` only and no leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def path_form_py(path: str) -> str:
    path = path.replace("\\", "/")
    while path.startswith("./"):
        path = path[2:].lstrip("/")
    return path


def package_form(name: Column) -> Column:
    """Lower case with ``-`` for ``_`` and ``.``."""
    return F.translate(F.lower(name), "_.", "--")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path_form(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty when the file name has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))
