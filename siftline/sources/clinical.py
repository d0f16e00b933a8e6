"""Readings of the clinical tables that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_visits(dxsum: DataFrame, *more: str) -> DataFrame:
    """RID, ID, EXAMDATE and the columns named: per (RID, VISCODE2) the row of the latest update_stamp, then of the smallest ID, if its EXAMDATE isn't null.

    An aggregate, not a window: rows of a frequent RID are reduced before the shuffle.
    """
    cols = ["EXAMDATE", *more]
    first = F.max_by(F.struct("ID", *cols), F.struct("update_stamp", -F.col("ID")))
    return dxsum.groupBy("RID", "VISCODE2").agg(first.alias("x")).select("RID", "x.*").where("EXAMDATE is not null and RID is not null")


def oasis_subject(mri_id: Column) -> Column:
    """The subject's id at the start of a MRI ID, or null."""
    return F.nullif(F.regexp_extract(mri_id, r"^(OAS[12]_\d+)", 1), F.lit(""))


def oasis_key(subject_id: Column) -> Column:
    """Cohort and number of an OASIS subject id however it is written (blanks, case, separators, leading zeros), e.g. OAS2_43; else null."""
    m = F.upper(F.regexp_replace(subject_id, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""))
    shape = "^OAS([12])[^0-9A-Z]*([0-9]+)$"
    return F.when(m.rlike(shape), F.concat(F.lit("OAS"), F.regexp_extract(m, shape, 1), F.lit("_"), F.regexp_replace(F.regexp_extract(m, shape, 2), "^0+(?=.)", "")))
