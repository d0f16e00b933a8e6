"""Reading files whose fields are added, renamed, removed or retyped into one table, with a report of changes.

1. Every JSON object is parsed once into cells (feed, file, record, field, type, value).
2. Each field of each file is profiled: its JSON type and a value sketch. A sketch has SLOTS slots; each holds,
   of the records with a value whose number hashes into it, the one of least hash and its value's hash. Two
   fields of consecutive files are sketched over the records of both files, so those with the same records
   filled hold the same ones, however few they are.
3. For each pair of consecutive files each field that went is paired with each that came; the sketches only rule
   out pairs that differ in more than a fifth of the slots shared, and a pair without shared slots stays.
4. All pairs left are checked against all values of both fields, and the best bipartite matching of those that
   hold is taken, weighed by records in common, name similarity and type.
5. Matched names are chained over the files of a feed, and records are read under the chain's target name.

Groups are fields of a file, never records of a file: a feed of any size is aggregated by partial sums.

Defined cases: a record that is null, no JSON or no object has no fields; a key with a null value counts as a
field; files sent twice count once, record by record (of different repeats, the last received, then the
largest text); a pair of files is compared only where both numbers exist; fields without a value in common in
the records of both files are never matched; a field that is null throughout a file has no type there and
causes no retyping; a type mixed of integers and decimals is "decimal", any other mixture is the most
frequent type, of equal ones the first by name; nested values are of type "array" or "object".
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.notation import canonical, code, moment, visit_code
from siftline.session import cut

SLOTS = 64


def latest(records: DataFrame) -> DataFrame:
    """One row per feed, file_no and rec_no, with the numbers of the files before and after that hold the record too."""
    r = records.select("feed", "file_no", "rec_no", "received_at", "record").where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).repartition("feed", "rec_no")
    r = r.groupBy("feed", "rec_no", "file_no").agg(F.max(F.struct("received_at", "record")).alias("x")).select("feed", "rec_no", "file_no", "x.record")
    w = Window.partitionBy("feed", "rec_no").orderBy("file_no")
    return r.withColumns({"was": F.coalesce(F.lag("file_no").over(w) == F.col("file_no") - 1, F.lit(False)), "will": F.coalesce(F.lead("file_no").over(w) == F.col("file_no") + 1, F.lit(False))})


def cells(records: DataFrame) -> DataFrame:
    """feed, file_no, rec_no, was, will, field, kind (JSON type; null for a null), value (string)."""
    c = records.sparkSession.sql("select feed, file_no, rec_no, was, will, key as field, schema_of_variant(value) as t, cast(value as string) as value from {r}, lateral variant_explode(try_parse_json(record)) where key is not null", r=records)
    t = F.col("t")
    kind = (
        F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when((t == "BIGINT") | t.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT") | t.startswith("STRUCT"), "object")
    )
    return c.withColumn("kind", kind).drop("t")


def profiles(read: DataFrame) -> DataFrame:
    """feed, file_no, field, kind, n (values), old and new (sketches over the records shared with the next, the previous file); read is from ``latest``."""
    c = cells(read)
    h = F.xxhash64("rec_no")
    c = c.withColumns({"slot": F.pmod(h, F.lit(SLOTS)).cast("int"), "h": F.xxhash64("rec_no", F.lit(7)), "v": F.when(F.col("value").isNotNull(), F.xxhash64(canonical(F.col("value"))))})
    kinds = ["string", "boolean", "integer", "decimal", "array", "object"]
    s = c.groupBy("feed", "file_no", "field", "slot").agg(F.min(F.when(F.col("will") & F.col("v").isNotNull(), F.struct("h", "v"))).alias("old"), F.min(F.when(F.col("was") & F.col("v").isNotNull(), F.struct("h", "v"))).alias("new"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))
    p = s.groupBy("feed", "file_no", "field").agg(*(F.sum(k).alias(k) for k in kinds), *(F.collect_list(F.when(F.col(x).isNotNull(), F.struct("slot", F.col(x)["h"].alias("h"), F.col(x)["v"].alias("v")))).alias(x) for x in ("old", "new")))
    n = sum((F.col(k) for k in kinds), F.lit(0))
    top = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(sorted(kinds)))))["k"]
    kind = F.when(n == 0, None).when((F.col("integer") + F.col("decimal") == n) & (F.col("decimal") > 0), F.lit("decimal")).otherwise(top)
    return p.select("feed", "file_no", "field", kind.alias("kind"), n.alias("n"), "old", "new")


def name_similarity(a: str, b: str) -> float:
    plain = [x.lower().translate({ord(c): None for c in " _.-"}) for x in (a, b)]
    return SequenceMatcher(None, *plain).ratio()


def assign(weight: list[list[float]]) -> list[int]:
    """For each row the column of the bipartite matching of greatest total weight, or -1 where none is above 0.

    Shortest augmenting paths with potentials; both sides are the fields of one file, so a few dozen at most.
    """
    n = max(len(weight), len(weight[0]))
    cost = [[-(weight[i][j] if i < len(weight) and j < len(weight[0]) else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], j0, far, back, done = i, n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[j0] != n:
            done[j0], i0, step, nxt = True, owner[j0], float("inf"), -1
            for j in range(n):
                if not done[j]:
                    d = cost[i0][j] - u[i0] - v[j]
                    if d < far[j]:
                        far[j], back[j] = d, j0
                    if far[j] < step:
                        step, nxt = far[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < n:
                    far[j] -= step
            j0 = nxt
        while j0 != n:
            owner[j0], j0 = owner[back[j0]], back[j0]
    out = [-1] * len(weight)
    for j in range(len(weight[0])):
        if owner[j] < len(weight) and weight[owner[j]][j] > 0:
            out[owner[j]] = j
    return out


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of a field that went and one that came which the sketches don't rule out."""
    for batch in batches:
        out = []
        for feed, no, gone, came in zip(batch["feed"], batch["file_no"], batch["gone"], batch["came"], strict=True):
            # a field without a value in the records of both files has an empty sketch and no partner
            olds, news = ([(x["field"], {s["slot"]: (s["h"], s["v"]) for s in x["sketch"]}) for x in side if len(x["sketch"])] for side in (gone, came))
            for g, old in olds:
                for c, new in news:
                    both = [old[k][1] == new[k][1] for k in old.keys() & new.keys() if old[k][0] == new[k][0]]
                    if not both or sum(both) >= 0.8 * len(both):
                        out.append((feed, no, g, c))
        yield pd.DataFrame(out, columns=["feed", "file_no", "prior_field", "field"])


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best matching of the pairs that passed the exact check."""
    for batch in batches:
        out = []
        for feed, no, edges in zip(batch["feed"], batch["file_no"], batch["edges"], strict=True):
            gone, came = (sorted({e[x] for e in edges}) for x in ("prior_field", "field"))
            at, most = {(e["prior_field"], e["field"]): e for e in edges}, max(e["n"] for e in edges)
            weight = [[1 + 0.2 * name_similarity(g, c) + 0.05 * e["alike"] + 0.1 * e["n"] / most if (e := at.get((g, c))) is not None else 0.0 for c in came] for g in gone]
            out += [(feed, no, gone[i], came[j]) for i, j in enumerate(assign(weight)) if j >= 0]
        yield pd.DataFrame(out, columns=["feed", "file_no", "prior_field", "field"])


def changes(records: DataFrame) -> DataFrame:
    """feed, file_no, change (renamed, added, removed, retyped), field, prior_field; see TESTDATA.md, p5_found."""
    read = cut(latest(records))
    return changes_of(read, cut(profiles(read)))


def changes_of(read: DataFrame, p: DataFrame) -> DataFrame:
    """The changes of records that were read once (``latest``) and their profiles."""
    files = p.select("feed", "file_no").distinct()
    pairs = files.join(files.select("feed", (F.col("file_no") + 1).alias("file_no")), ["feed", "file_no"])
    a = p.select("feed", (F.col("file_no") + 1).alias("file_no"), "field", F.col("kind").alias("k0"), "old").join(pairs, ["feed", "file_no"], "left_semi")
    b = p.select("feed", "file_no", "field", F.col("kind").alias("k1"), "new").join(pairs, ["feed", "file_no"], "left_semi")
    both = cut(a.join(b, ["feed", "file_no", "field"], "full").withColumn("side", F.when(F.col("old").isNull(), "came").when(F.col("new").isNull(), "gone").otherwise("both")))
    gone = both.where("side = 'gone'")
    came = both.where("side = 'came'")
    g = gone.groupBy("feed", "file_no").agg(F.collect_list(F.struct("field", F.col("k0").alias("kind"), F.col("old").alias("sketch"))).alias("gone"))
    c = came.groupBy("feed", "file_no").agg(F.collect_list(F.struct("field", F.col("k1").alias("kind"), F.col("new").alias("sketch"))).alias("came"))
    pair = "feed string, file_no int, prior_field string, field string"
    held = _checked(read, cut(g.join(c, ["feed", "file_no"]).mapInPandas(_possible, pair)))
    kinds = [gone.select("feed", "file_no", F.col("field").alias("prior_field"), "k0"), came.select("feed", "file_no", "field", "k1")]
    edges = held.join(kinds[0], ["feed", "file_no", "prior_field"]).join(kinds[1], ["feed", "file_no", "field"]).groupBy("feed", "file_no").agg(F.collect_list(F.struct("prior_field", "field", "n", F.coalesce(F.col("k0") == F.col("k1"), F.lit(False)).alias("alike"))).alias("edges"))
    renamed = cut(edges.mapInPandas(_match, pair))
    out = [
        renamed.select("feed", "file_no", F.lit("renamed").alias("change"), "field", "prior_field"),
        gone.join(renamed.select("feed", "file_no", F.col("prior_field").alias("field")), ["feed", "file_no", "field"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change"), "field", F.col("field").alias("prior_field")),
        came.join(renamed, ["feed", "file_no", "field"], "left_anti").select("feed", "file_no", F.lit("added").alias("change"), "field", F.col("field").alias("prior_field")),
        both.where("side = 'both' and k0 <> k1").select("feed", "file_no", F.lit("retyped").alias("change"), "field", F.col("field").alias("prior_field")),
        renamed.join(kinds[0], ["feed", "file_no", "prior_field"]).join(kinds[1], ["feed", "file_no", "field"]).where("k0 <> k1").select("feed", "file_no", F.lit("retyped").alias("change"), "field", "prior_field"),
    ]
    r = out[0]
    for x in out[1:]:
        r = r.unionByName(x)
    return r


def _checked(read: DataFrame, likely: DataFrame) -> DataFrame:
    """The pairs whose values agree in every record of both files that has both, with n, the number of these records."""
    sides = likely.select("feed", F.explode(F.array(F.struct((F.col("file_no") - 1).alias("file_no"), F.lit(0).alias("side"), F.col("prior_field").alias("name")), F.struct("file_no", F.lit(1).alias("side"), F.col("field").alias("name")))).alias("x"), F.col("file_no").alias("to"), "prior_field", "field")
    per = sides.groupBy("feed", "x.file_no").agg(F.collect_list(F.struct("x.side", "x.name", "to", "prior_field", "field")).alias("ps"))
    # only the paired fields' cells are made, and the records of a file are never joined with each other
    r = read.join(per, ["feed", "file_no"]).withColumn("m", F.from_json("record", "map<string,string>"))
    c = r.select("feed", "rec_no", "m", F.explode("ps").alias("p")).select("feed", "rec_no", "p.*", canonical(F.try_element_at("m", F.col("p.name"))).alias("v")).where("v is not null")
    met = c.groupBy("feed", "to", "rec_no", "prior_field", "field").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("v1")).where("v0 is not null and v1 is not null")
    return met.groupBy("feed", F.col("to").alias("file_no"), "prior_field", "field").agg(F.bool_and(F.col("v0") == F.col("v1")).alias("same"), F.count("*").alias("n")).where("same").drop("same")


def lineage(profile: DataFrame, change: DataFrame, target: list[str]) -> DataFrame:
    """feed, file_no, field, name: under which name of the target, or of its own chain, each field is read.

    Fields are linked to the previous file's (by name or renaming), and each finds its chain's start by
    pointer doubling. A chain with a name like one of the target's (letters and digits compared, case not)
    is that target field; else it keeps its first name. Of two chains of one name in a file, the field
    spelled like the target comes first; others get a "~" behind the name.
    """
    me = profile.select("feed", "file_no", "field")
    ren = change.where("change = 'renamed'").select("feed", "file_no", "field", "prior_field")
    before = me.select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("field").alias("same"), F.lit(True).alias("known"))
    up = me.join(ren, ["feed", "file_no", "field"], "left").withColumn("same", F.col("field")).join(before, ["feed", "file_no", "same"], "left")
    up = up.select("feed", "file_no", "field", F.coalesce("prior_field", F.when(F.col("known"), F.col("field"))).alias("pf"))
    up = cut(up.withColumns({"pn": F.when(F.col("pf").isNotNull(), F.col("file_no") - 1).otherwise(F.col("file_no")), "pf": F.coalesce("pf", "field")}))
    n = up.agg(F.max("file_no") - F.min("file_no")).first()[0] or 0
    for _ in range(int(n).bit_length()):
        nxt = up.select("feed", F.col("file_no").alias("pn"), F.col("field").alias("pf"), F.col("pn").alias("qn"), F.col("pf").alias("qf"))
        up = cut(up.join(nxt, ["feed", "pn", "pf"], "left").select("feed", "file_no", "field", F.coalesce("qn", "pn").alias("pn"), F.coalesce("qf", "pf").alias("pf")))
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    like = F.create_map(*(F.lit(x) for t in target for x in ("".join(ch for ch in t if ch.isalnum()).lower(), t)))
    up = up.withColumn("hit", F.try_element_at(like, plain(F.col("field"))))
    chain = up.groupBy("feed", "pn", "pf").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("file_no"))).alias("hit"))
    named = up.drop("hit").join(chain, ["feed", "pn", "pf"]).withColumn("name", F.coalesce("hit", "pf"))
    w = Window.partitionBy("feed", "file_no", "name").orderBy((F.col("field") == F.col("name")).desc(), F.col("hit").isNotNull().desc(), "field")
    return named.withColumn("k", F.row_number().over(w)).select("feed", "file_no", "field", F.concat("name", F.expr("repeat('~', k - 1)")).alias("name"))


def unify(records: DataFrame, target: T.StructType, keep_text: tuple[str, ...] = ("VISCODE2",), most_extras: int = 500) -> DataFrame:
    """One row per feed, file_no and rec_no with the target's fields and types, and the extra fields as strings.

    Values are read in any notation of siftline.functions.notation; one that can't be read as the target's
    type is null. Extra fields become columns of their own; beyond ``most_extras`` of them, or where a name
    clashes with feed, file_no or rec_no, they are entries of the map column ``more``.
    """
    read = cut(latest(records))
    p = cut(profiles(read))
    lin = cut(lineage(p, changes_of(read, p), target.names))
    names = [r[0] for r in lin.where(~F.col("name").isin(target.names)).select("name").distinct().orderBy("name").limit(most_extras).collect()]
    extras = [x for x in names if x.lower() not in {"feed", "file_no", "rec_no", "more", *map(str.lower, target.names)}]
    maps = lin.groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
    r = read.join(maps, ["feed", "file_no"], "left")
    r = r.withColumn("m", F.transform_keys(F.from_json("record", "map<string,string>"), lambda k, _: F.coalesce(F.try_element_at("names", k), k)))
    have = set(target.names) | set(extras)
    return r.select(
        "feed", "file_no", "rec_no", *(_typed(F.try_element_at("m", F.lit(f.name)), f, keep_text).alias(f.name) for f in target.fields),
        *(F.try_element_at("m", F.lit(x)).alias(x) for x in extras), F.map_filter("m", lambda k, _: ~k.isin(*have)).alias("more"),
    )


def _typed(v: Column, f: T.StructField, codes: tuple[str, ...]) -> Column:
    kind = f.dataType.simpleString()
    if f.name in codes:
        return visit_code(v)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return moment(v).cast(kind)
    if kind in ("double", "float"):
        return code(v).cast(kind)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.round(code(v)).try_cast(kind)
    return v.try_cast(kind)
