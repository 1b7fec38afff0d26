"""Column expressions for names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Unicode white space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """Comparison form of a name: case and underscores ignored, white space squeezed.

    Null stays null; a name of blanks gives the empty string.
    """
    return F.lower(squeeze(F.translate(c, "_", " ")))


def matcher_name(c: Column) -> Column:
    """Lower case, underscores as blanks, trimmed: the form the extractor merge compares."""
    return F.trim(F.translate(F.lower(c), "_", " "))


def entity_id(name: Column) -> Column:
    return F.concat(F.translate(F.lower(name), " ", "_"), F.lit("_"), F.left(F.sha2(name, 256), F.lit(8)))


def claim_id(source: Column, target: Column, evidence: Column, text: Column) -> Column:
    slug = F.left(F.translate(F.lower(F.concat_ws("_", source, target)), " ", "_"), F.lit(40))
    digest = F.left(F.sha2(F.concat_ws("|", source, target, evidence, text), 256), F.lit(12))
    return F.concat(slug, F.lit("_"), digest)
