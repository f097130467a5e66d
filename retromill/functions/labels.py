"""Labels of genomes from the paths of their files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The last part of a path, without slashes after it."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def genome_label(path: Column) -> Column:
    """The file's name up to its first dot. Null gives null."""
    return F.substring_index(file_name(path), ".", 1)


def haplotype_tag(path: Column) -> Column:
    """'.pri' or '.alt' if the file's name has that part, else ''."""
    name = file_name(path)
    return F.when(name.contains(".pri."), ".pri").when(name.contains(".alt."), ".alt").when(name.isNotNull(), "")


def gml_safe(label: Column) -> Column:
    """A label without the letters that GML readers stumble on."""
    return F.regexp_replace(label, "[-_.]", "")
