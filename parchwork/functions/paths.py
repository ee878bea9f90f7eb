"""Paths and the names made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_html(path: Column) -> Column:
    """Whether a file's suffix is .html or .htm in any case; a name that is only a suffix has none."""
    return F.lower(base_name(path)).rlike(r"[^/]\.html?\z")


def is_markup(path: Column) -> Column:
    """Whether a name ends in .html, .htm or .xhtml in any case."""
    return F.lower(base_name(path)).rlike(r"\.(?:html?|xhtml)\z")


def is_under(path: Column, root: Column) -> Column:
    """Whether a path is the root or below it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """A path below the root as seen from there."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2, F.length(path))).otherwise(path)


def without_extension(path: Column) -> Column:
    """A path without its last suffix; leading dots of the name are no suffix."""
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*\z", "")


def output_name(relative_path: Column) -> Column:
    """The name of a document's text file: its relative path in one level."""
    return F.concat(F.translate(without_extension(relative_path), "/", "_"), F.lit(".txt"))


def short_name(relative_path: Column, root: Column) -> Column:
    """How reports name a document: the root folder's name and the relative path."""
    return F.concat_ws("/", base_name(root), relative_path)
