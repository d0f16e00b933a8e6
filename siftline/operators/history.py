"""History of changing attributes: insert-only satellites and lead-based views.

A satellite holds, for each key, one row a version: the time from which it held, the attributes, their hash
(``hash_diff``) and ``seq``, what decides among several records of one time. Rows are only ever appended, and
only where the hash differs from the version before. End dates are never stored; ``version_view`` derives them.
Attributes that change at different rates belong into separate satellites (``split_by_change_rate``), so that a
fast one doesn't copy the slow ones.

Records may come late. What was confirmed, but not stored as it changed nothing, matters again once a late
record falls between; so beside the satellite a slim insert-only table (``track``: key, time, seq) keeps the
hash of every record that decided its time. ``append_snapshot`` returns the rows to append to both, so that
satellite and view are the same whatever batches the records came in, and in whatever order:

* a time without a stored row gets one where its hash differs from the time before it, be the record new or,
  as a late one now stands before it, an old confirmation whose attributes are copied from an earlier version;
* a time with a stored row gets another where a new record of larger seq decides now.

Defined cases: records whose key or time is null are no part of any history; nulls of an attribute are a
value of their own in the hash (filter them before, if they mean "unknown"); repeated records make no
version; of several records at one time the largest in the order of ``tie`` columns decides (then that of the
largest hash); an empty table gives an empty history. Extra columns are ignored; names that begin with an
underscore, and seq, hash_diff and valid_from, are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.keyblocks import blocked, neighbour


def hash_diff(attributes: list[str]) -> Column:
    """Hash (16 bytes) of the attributes in which null, empty and NaN values are told apart."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(f"`{a}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{a}`").cast("string")), F.lit("-")) for a in attributes))))


def _deciding(records: DataFrame, key: str, at: str, attributes: list[str], tie: list[Column] | None) -> DataFrame:
    """key, at, seq, _p (struct of the attributes): the record that decides each time. An aggregate by key and time, so no key is a hot spot."""
    seq = F.struct(*(c.alias(f"t{i}") for i, c in enumerate(tie or [])), hash_diff(attributes).alias("hash"))
    r = records.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), seq.alias("seq"), F.struct(*(F.col(f"`{a}`") for a in attributes)).alias("_p"))
    return r.groupBy(key, at).agg(F.max_by("_p", "seq").alias("_p"), F.max("seq").alias("seq"))


def split_by_change_rate(records: DataFrame, key: str, at: str, attributes: list[str], fast: float = 0.2) -> tuple[list[str], list[str]]:
    """(fast, slow): attributes that change on at least, or less than, the share ``fast`` of steps.

    One row of counts comes to the driver.
    """
    r = neighbour(blocked(_deciding(records, key, at, attributes, None), [key], F.col(at)), [key], [F.col(at)], F.col("_p"), "_q")
    row = r.where("_q is not null").agg(*(F.avg((~F.col(f"_p.`{a}`").eqNullSafe(F.col(f"_q.`{a}`"))).cast("int")).alias(f"c{i}") for i, a in enumerate(attributes))).first()
    rate = {a: (row[f"c{i}"] or 0.0) for i, a in enumerate(attributes)}
    return [a for a in attributes if rate[a] >= fast], [a for a in attributes if rate[a] < fast]


def track(records: DataFrame, key: str, at: str, attributes: list[str], tie: list[Column] | None = None) -> DataFrame:
    """key, at, seq: which hash each time of the records was decided by."""
    return _deciding(records, key, at, attributes, tie).select(key, at, "seq")


def satellite(records: DataFrame, key: str, at: str, attributes: list[str], tie: list[Column] | None = None) -> DataFrame:
    """key, valid_from, attributes, hash_diff, seq: the versions, built from snapshots or updates in any order."""
    r = blocked(_deciding(records, key, at, attributes, tie), [key], F.col(at))
    r = neighbour(r, [key], [F.col(at)], F.col("seq.hash"), "_before").where(F.col("_before").isNull() | (F.col("_before") != F.col("seq.hash")))
    return r.select(F.col(key), F.col(at).alias("valid_from"), "_p.*", F.col("seq.hash").alias("hash_diff"), "seq")


def append_snapshot(sat: DataFrame, seen: DataFrame, records: DataFrame, key: str, at: str, attributes: list[str], tie: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the satellite, rows to append to ``seen``, its tracking table) for new records, late ones included."""
    new = _deciding(records, key, at, attributes, tie)
    known = F.struct(*(F.col(f"`{a}`") for a in attributes))
    kind = dict(new.dtypes)["_p"]
    # only the keys that have new records are read on
    touched = new.select(key).distinct()
    stored = sat.join(touched, key, "left_semi")
    e = new.select(key, at, "seq", "_p", F.lit(False).alias("_stored"))
    e = e.unionByName(seen.join(touched, key, "left_semi").select(key, at, "seq", F.lit(None).cast(kind).alias("_p"), F.lit(False).alias("_stored")))
    e = e.unionByName(stored.select(key, F.col("valid_from").alias(at), "seq", known.alias("_p"), F.lit(True).alias("_stored")))
    e = e.groupBy(key, at).agg(F.max_by("_p", F.struct("seq", F.col("_p").isNotNull())).alias("_p"), F.max(F.when(F.col("_stored"), F.col("seq"))).alias("_had"), F.max("seq").alias("seq"))
    e = neighbour(blocked(e, [key], F.col(at)), [key], [F.col(at)], F.col("seq.hash"), "_before")
    change = F.when(F.col("_had").isNotNull(), F.col("_had.hash") != F.col("seq.hash")).otherwise(F.col("_before").isNull() | (F.col("_before") != F.col("seq.hash")))
    e = e.where(change).select(key, F.col(at).alias("valid_from"), "_p", F.col("seq.hash").alias("hash_diff"), "seq")
    # a confirmation that became a version: its attributes were stored before, under the same key and hash
    back = e.where("_p is null").drop("_p").join(stored.groupBy(key, "hash_diff").agg(F.first(known).alias("_p")), [key, "hash_diff"])
    e = e.where("_p is not null").unionByName(back)
    return e.select(key, "valid_from", "_p.*", "hash_diff", "seq"), new.select(key, at, "seq")


def version_view(sat: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """The satellite with valid_to (null: still holds) and is_current; versions equal to the one before, in the attributes ``only`` if given, are skipped."""
    cols = [c for c in sat.columns if c not in (key, "valid_from", "seq", "hash_diff") and (only is None or c in only)]
    v = sat.groupBy(key, "valid_from").agg(F.max_by(F.struct(*(f"`{c}`" for c in cols)), "seq").alias("_p")).select(key, "valid_from", "_p.*")
    v = blocked(v.withColumn("hash_diff", hash_diff(cols)), [key], F.col("valid_from"))
    r = neighbour(v, [key], [F.col("valid_from")], F.col("hash_diff"), "_before").where(F.col("_before").isNull() | (F.col("_before") != F.col("hash_diff")))
    r = neighbour(r, [key], [F.col("valid_from")], F.col("valid_from"), "valid_to", ahead=True)
    return r.withColumn("is_current", F.col("valid_to").isNull()).drop("_before", "_blk", "_hot")
