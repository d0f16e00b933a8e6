"""Rules that read a hypothesis in plain text: target, mode and region, as column expressions over any number of texts.

Fixed values below are the words the rules look for; the first rule that matches counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGETS = [("conversion", ["convert", "conversion", "progress", "progression"]), ("scanner", ["scanner", "field strength", "vendor"]), ("site", ["site", "center", "centre"]), ("dx_binary", ["diagnosis", "dementia", "alzheimer", "ad", "patients"])]
UNSUPERVISED = ["cluster", "clusters", "subtype", "subtypes", "phenotype", "phenotypes", "discover"]
REGIONS = ["hippocampus", "left hippocampus", "right hippocampus", "entorhinal cortex", "amygdala", "thalamus", "precuneus", "insula", "ventricles"]
FORBIDDEN = ["proves", "cures", "guarantees", "definitive"]


def has_word(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, whole words only, case ignored."""
    return F.coalesce(F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(False))


def target(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(TARGETS):
        out = F.when(has_word(text, words), name).otherwise(out)
    return out


def mode(text: Column) -> Column:
    return F.when(has_word(text, UNSUPERVISED), "unsupervised").otherwise("supervised")


def region(text: Column) -> Column:
    """The longest known region in the text."""
    found = F.filter(F.array(*(F.when(has_word(text, [r]), F.lit(r)) for r in sorted(REGIONS, key=lambda r: (-len(r), r)))), F.isnotnull)
    return F.get(found, 0)


def overclaims(text: Column) -> Column:
    return has_word(text, FORBIDDEN)


def text_key(text: Column) -> Column:
    """SHA-1 of the text with blanks made single."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))
