"""Queries p2, p3 and p5: histories, filled values and drifting schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import drift, history, impute
from siftline.session import cut, number, table
from siftline.sources.clinical import current_visits, oasis_subject


def _adni_records(spark: SparkSession, d: str) -> DataFrame:
    """subject, at, state, site, phase, stamp, ID: the current visits with a state, written once as they are read several times."""
    v = current_visits(table(spark, d, "dxsum"), "DIAGNOSIS", "SITEID", "PHASE", "update_stamp").where("DIAGNOSIS in (1, 2, 3)")
    return cut(v.select(F.col("RID").alias("subject"), F.col("EXAMDATE").alias("at"), F.col("DIAGNOSIS").cast("int").cast("string").alias("state"), F.col("SITEID").alias("site"), F.col("PHASE").alias("phase"), F.col("update_stamp").alias("stamp"), "ID"))


def _oasis_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "oasis_longitudinal").select(oasis_subject(F.col("MRI ID")).alias("subject"), F.col("Visit").alias("at"), number("CDR").alias("cdr"), number("MMSE").alias("mmse"), number("SES").alias("ses"))
    return cut(o.where("cdr is not null").select("subject", "at", F.format_string("%.1f", "cdr").alias("state"), "mmse", "ses"))


def _satellites(records: DataFrame, attributes: list[str], tie: list[Column] | None, late: Column, wanted: list[str]) -> dict[str, DataFrame]:
    """The satellite of each attribute wanted: split by change rate, loaded with the first records and appended to with the late ones."""
    out, groups = {}, history.split_by_change_rate(records, "subject", "at", attributes)
    for group in groups:
        if set(group) & set(wanted):
            first = records.where(~F.coalesce(late, F.lit(False)))
            sat = cut(history.satellite(first, "subject", "at", group, tie))
            seen = history.track(first, "subject", "at", group, tie)
            add, _ = history.append_snapshot(sat, seen, records.where(late), "subject", "at", group, tie)
            out |= dict.fromkeys(group, sat.unionByName(add))
    return out


def _histories(spark: SparkSession, d: str, cohort: str, wanted: list[str]) -> list[DataFrame]:
    """The view of each attribute wanted. adni: what was entered in the second half of the time of entry is the late batch; oasis: what came after the second visit."""
    if cohort == "adni":
        r, attributes, tie = _adni_records(spark, d), ["state", "site", "phase"], [-F.col("ID")]
        half = r.agg(F.timestamp_micros(((F.unix_micros(F.min("stamp").cast("timestamp")) + F.unix_micros(F.max("stamp").cast("timestamp"))) / 2).cast("long")).cast("timestamp_ntz")).first()[0]
        late = F.col("stamp") > F.lit(half)
    else:
        r, attributes, tie, late = _oasis_records(spark, d), ["state", "mmse", "ses"], None, F.col("at") > 2
    sats = _satellites(r, attributes, tie, late, wanted)
    return [history.version_view(sats[a], "subject", [a]) for a in wanted]


def _as_text(df: DataFrame, cohort: str, column: str) -> DataFrame:
    when = lambda c: F.substring(F.col(c).cast("string"), 1, 19)
    return df.select(F.lit(cohort).alias("cohort"), F.col("subject").cast("string").alias("subject"), when("valid_from").alias("valid_from"), when("valid_to").alias("valid_to"), F.col(column).cast("string").alias("value"), "is_current")


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    """The states with the period of each, from the lead-based view of satellites that were appended to."""
    v = _as_text(_histories(spark, d, "adni", ["state"])[0], "adni", "state").unionByName(_as_text(_histories(spark, d, "oasis", ["state"])[0], "oasis", "state"))
    return v.withColumnRenamed("value", "state")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_history(spark, d).select("cohort", "subject", "valid_from", "state")


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each attribute's own history (null is a value) at the records that have a state: phase and site of adni, MMSE and SES of oasis."""
    parts = [_as_text(v, c, a).withColumn("attribute", F.lit(a)) for c, names in (("adni", ["site", "phase"]), ("oasis", ["mmse", "ses"])) for a, v in zip(names, _histories(spark, d, c, names), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


P2_STATES = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID, VISCODE2 ORDER BY update_stamp DESC, ID) k FROM dxsum) WHERE k = 1 AND EXAMDATE IS NOT NULL),
s AS (
 SELECT 'adni' AS cohort, CAST(RID AS VARCHAR) AS subject, epoch_us(EXAMDATE) AS o, strftime(EXAMDATE, '%Y-%m-%d %H:%M:%S') AS at_text, CAST(CAST(DIAGNOSIS AS INT) AS VARCHAR) AS state, ID AS tie FROM cur WHERE DIAGNOSIS IN (1, 2, 3)
 UNION ALL
 SELECT DISTINCT 'oasis', regexp_extract("MRI ID", '^(OAS2_[0-9]+)', 1), CAST(Visit AS BIGINT), CAST(Visit AS VARCHAR), printf('%.1f', CDR), 0 FROM oasis_longitudinal WHERE CDR IS NOT NULL AND NOT isnan(CDR) AND Visit IS NOT NULL
), c AS (SELECT *, lag(state) OVER (PARTITION BY cohort, subject ORDER BY o, tie DESC) AS before FROM s), v AS (SELECT * FROM c WHERE before IS NULL OR before <> state)
"""
P2_FOUND = P2_STATES + "SELECT cohort, subject, at_text AS valid_from, state FROM v"
P2_HISTORY = P2_STATES + "SELECT cohort, subject, at_text AS valid_from, lead(at_text) OVER w AS valid_to, state, lead(at_text) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY cohort, subject ORDER BY o)"


P2_ATTRIBUTES = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID, VISCODE2 ORDER BY update_stamp DESC, ID) k FROM dxsum) WHERE k = 1 AND EXAMDATE IS NOT NULL AND RID IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY RID, EXAMDATE ORDER BY ID) n FROM cur WHERE DIAGNOSIS IN (1, 2, 3)),
o AS (SELECT DISTINCT regexp_extract("MRI ID", '^(OAS2_[0-9]+)', 1) AS subject, CAST(Visit AS BIGINT) AS o, CASE WHEN NOT isnan(MMSE) THEN MMSE END AS mmse, CASE WHEN NOT isnan(SES) THEN SES END AS ses FROM oasis_longitudinal WHERE CDR IS NOT NULL AND NOT isnan(CDR) AND Visit IS NOT NULL),
a AS (
 SELECT 'adni' AS cohort, CAST(RID AS VARCHAR) AS subject, 'site' AS attribute, epoch_us(EXAMDATE) AS o, strftime(EXAMDATE, '%Y-%m-%d %H:%M:%S') AS at_text, CAST(SITEID AS VARCHAR) AS v FROM d WHERE n = 1
 UNION ALL SELECT 'adni', CAST(RID AS VARCHAR), 'phase', epoch_us(EXAMDATE), strftime(EXAMDATE, '%Y-%m-%d %H:%M:%S'), PHASE FROM d WHERE n = 1
 UNION ALL SELECT 'oasis', subject, 'mmse', o, CAST(o AS VARCHAR), CAST(mmse AS VARCHAR) FROM o UNION ALL SELECT 'oasis', subject, 'ses', o, CAST(o AS VARCHAR), CAST(ses AS VARCHAR) FROM o
), c AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY cohort, subject, attribute ORDER BY o)), v AS (SELECT * FROM c WHERE n = 1 OR before IS DISTINCT FROM v)
SELECT cohort, subject, attribute, at_text AS valid_from, lead(at_text) OVER w AS valid_to, v AS value, lead(at_text) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY cohort, subject, attribute ORDER BY o)
"""

SES, MMSE = impute.Field("SES", 1, 5, "category"), impute.Field("MMSE", 0, 30, "number")


def _filled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cross = impute.fill(table(spark, d, "oasis_cross_sectional"), {"sex": F.col("M/F"), "educ": F.col("Educ")}, F.col("Age"), [SES, MMSE])
    long = impute.fill(table(spark, d, "oasis_longitudinal"), {"subject": oasis_subject(F.col("MRI ID"))}, F.col("Visit"), [SES])
    return cross, long


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cross, long = _filled(spark, d)
    masks = [("oasis_cross_sectional", cross, "ID", "SES"), ("oasis_cross_sectional", cross, "ID", "MMSE"), ("oasis_longitudinal", long, "MRI ID", "SES")]
    # both masks of a table are read in one pass
    a = cross.select(F.lit("oasis_cross_sectional").alias("source_table"), F.col("ID").alias("record_id"), F.explode(F.filter(F.array(*(F.when(F.col(f"{f}_filled"), F.lit(f)) for _, t, _, f in masks if t is cross)), F.isnotnull)).alias("field"))
    b = long.where("SES_filled").select(F.lit("oasis_longitudinal").alias("source_table"), F.col("MRI ID").alias("record_id"), F.lit("SES").alias("field"))
    return a.unionByName(b).distinct()


def p3_cross_sectional(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[0]


def p3_longitudinal(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[1]


P3_FOUND = """
WITH c AS (SELECT ID AS id, "M/F" AS sex, Educ AS educ, CASE WHEN SES BETWEEN 1 AND 5 THEN SES END AS ses, CASE WHEN MMSE BETWEEN 0 AND 30 THEN MMSE END AS mmse FROM oasis_cross_sectional),
l AS (SELECT "MRI ID" AS id, regexp_extract("MRI ID", '^(OAS2_[0-9]+)', 1) AS s, CASE WHEN SES BETWEEN 1 AND 5 THEN SES END AS ses FROM oasis_longitudinal),
g AS (SELECT sex, educ, count(ses) AS ns, count(mmse) AS nm FROM c GROUP BY sex, educ), h AS (SELECT s, count(ses) AS ns FROM l GROUP BY s)
SELECT DISTINCT 'oasis_cross_sectional' AS source_table, id AS record_id, 'SES' AS field FROM c JOIN g USING (sex, educ) WHERE ses IS NULL AND ns > 0
UNION ALL SELECT DISTINCT 'oasis_cross_sectional', id, 'MMSE' FROM c JOIN g USING (sex, educ) WHERE mmse IS NULL AND nm > 0
UNION ALL SELECT DISTINCT 'oasis_longitudinal', id, 'SES' FROM l JOIN h USING (s) WHERE ses IS NULL AND ns > 0
"""


def _group_sql(f: impute.Field, table: str, of: str, time: str) -> str:
    """CTEs of one field: k (whole rows once), v (its valid values: g, t, v) and the totals that both models share."""
    return f"""k AS (SELECT DISTINCT * FROM {table}), v AS (SELECT {of} AS g, CAST({time} AS DOUBLE) AS t, CAST({f.name} AS DOUBLE) AS v FROM k WHERE {f.name} BETWEEN {f.low} AND {f.high} AND {of} IS NOT NULL)"""


def _number_sql(f: impute.Field, table: str, of: str, time: str) -> str:
    """m(g, guess at time 0, slope): shrunk group effects and the pooled slope, from sums."""
    return f"""{_group_sql(f, table, of, time)},
s AS (SELECT g, count(*) n, sum(v) sv, sum(v * v) svv, count(t) nt, coalesce(sum(t), 0) st, coalesce(sum(t * t), 0) stt, coalesce(sum(v) FILTER (t IS NOT NULL), 0) sv1, coalesce(sum(v * t), 0) svt FROM v GROUP BY g),
x AS (SELECT *, CASE WHEN nt > 0 THEN svt - st * sv1 / nt ELSE 0 END AS xy, CASE WHEN nt > 0 THEN stt - st * st / nt ELSE 0 END AS xx FROM s),
o AS (SELECT sum(n) all_n, count(*) J, sum(sv) / sum(n) mu, coalesce(sum(st) / sum(nt), 0) mid, coalesce(sum(xy) / nullif(sum(xx), 0), 0) slope, sum(n * n) nn, sum(svv - sv * sv / n) within_, sum(xy) sxy FROM x),
r AS (SELECT *, sv / n - mu - slope * coalesce(st / nullif(nt, 0) - mid, 0) AS rest FROM x, o), b AS (SELECT sum(n * rest * rest) - sum(n * rest) * sum(n * rest) / sum(n) AS between_ FROM r),
e AS (SELECT *, greatest((within_ - slope * sxy) / greatest(all_n - J - 1, 1), 1e-9) AS e2, greatest((between_ / greatest(J - 1, 1) - greatest((within_ - slope * sxy) / greatest(all_n - J - 1, 1), 1e-9)) / greatest((all_n - nn / all_n) / greatest(J - 1, 1), 1), 0) AS u2 FROM r, b),
m AS (SELECT g, mu + n * u2 / (n * u2 + e2) * rest AS base, slope, mid FROM e)"""


def _category_sql(f: impute.Field, table: str, of: str, time: str) -> str:
    """m(g, k, a, b, mid): the score a + b * time of each category."""
    return f"""{_group_sql(f, table, of, time)},
y AS (SELECT g, round(v) AS k, count(*) c, count(t) ct, sum(t) st, sum(t * t) stt FROM v GROUP BY ALL), z AS (SELECT k, sum(c) C, sum(ct) CT, sum(st) ST, sum(stt) STT FROM y GROUP BY k),
o AS (SELECT sum(C) all_n, coalesce(sum(ST) / sum(CT), 0) mid, coalesce(sum(STT - coalesce(ST * ST / nullif(CT, 0), 0)) / nullif(sum(CT), 0), 0) s2, sum(C * C) / (sum(C) * sum(C)) AS chance FROM z),
h AS (SELECT g, sum(c) n, sum(c * (c - 1)) same FROM y GROUP BY g), q AS (SELECT sum(same) / nullif(sum(n * (n - 1)), 0) AS agree FROM h),
w AS (SELECT *, (1 - rho) / rho AS alpha FROM (SELECT *, least(greatest((coalesce(agree, chance) - chance) / greatest(1 - chance, 1e-9), 0.001), 0.999) AS rho FROM o, q)),
m AS (SELECT h.g, z.k, ln((coalesce(y.c, 0) + alpha * z.C / all_n) / (n + alpha)) - CASE WHEN s2 > 0 THEN pow(coalesce(z.ST / nullif(z.CT, 0), 0), 2) / (2 * greatest(s2, 1e-9)) ELSE 0 END AS a, CASE WHEN s2 > 0 THEN coalesce(z.ST / nullif(z.CT, 0), 0) / greatest(s2, 1e-9) ELSE 0 END AS b, mid FROM h CROSS JOIN z CROSS JOIN w LEFT JOIN y ON y.g = h.g AND y.k = z.k)"""


def _filled_sql(table: str, of: str, time: str, fields: list[impute.Field]) -> str:
    """All rows of the table with each field filled where its group has a model."""
    names = ", ".join(f.name for f in fields)
    out = f"WITH t0 AS (SELECT *, row_number() OVER () AS _row, {of} AS _g, CAST({time} AS DOUBLE) AS _t FROM {table})"
    for f in fields:
        guess = f"least(greatest(round(base + slope * (coalesce(_t, mid) - mid), 6), {f.low}), {f.high})" if f.kind == "number" else "arg_max(k, struct_pack(s := a + b * coalesce(_t, mid), k := -k))"
        model = (_number_sql if f.kind == "number" else _category_sql)(f, table, of, time)
        out += f", g_{f.name} AS (WITH {model} SELECT _row, {guess} AS guess FROM t0 JOIN m ON m.g = t0._g {'GROUP BY _row' if f.kind == 'category' else ''})"
    valid = lambda f: f"CASE WHEN {f.name} BETWEEN {f.low} AND {f.high} THEN CAST({f.name} AS DOUBLE) END"
    cells = ", ".join(f"coalesce({valid(f)}, g_{f.name}.guess) AS {f.name}, {valid(f)} IS NULL AND g_{f.name}.guess IS NOT NULL AS {f.name}_filled" for f in fields)
    joins = " ".join(f"LEFT JOIN g_{f.name} ON g_{f.name}._row = t0._row" for f in fields)
    return f"{out} SELECT t0.* EXCLUDE ({names}, _row, _g, _t), {cells} FROM t0 {joins}"


P3_CROSS = _filled_sql("oasis_cross_sectional", """CASE WHEN "M/F" IS NOT NULL AND Educ IS NOT NULL THEN "M/F" || '/' || Educ END""", "Age", [SES, MMSE])
P3_LONG = _filled_sql("oasis_longitudinal", """nullif(regexp_extract("MRI ID", '^(OAS[12]_[0-9]+)', 1), '')""", "Visit", [SES])


_DAY = """CASE WHEN regexp_full_match(s, '\\d{4}-\\d\\d-\\d\\d') THEN try_strptime(s, '%Y-%m-%d')::DATE WHEN regexp_matches(s, '^\\d{4}-\\d\\d-\\d\\d[t ]\\d\\d:\\d\\d') THEN TRY_CAST(upper(s) AS TIMESTAMP)::DATE WHEN regexp_full_match(s, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(s, '%m/%d/%Y')::DATE
 WHEN regexp_full_match(s, '\\d{1,2}[a-z]{3}\\d{4}') THEN try_strptime(s, '%d%b%Y')::DATE WHEN regexp_full_match(n, '(19|20)\\d{6}') THEN try_strptime(n, '%Y%m%d')::DATE WHEN regexp_full_match(n, '-?\\d{9,10}') THEN make_timestamp(n::BIGINT * 1000000)::DATE WHEN regexp_full_match(n, '-?\\d{12,13}') THEN make_timestamp(n::BIGINT * 1000)::DATE END"""
_NUMBER = """coalesce(map_extract(MAP {'cn': 1.0, 'mci': 2.0, 'dementia': 3.0, 'ad': 3.0, 'bl': 0.0, 'true': 1.0, 'false': 0.0}, s)[1], CASE WHEN regexp_matches(s, '^m?-?\\d+(\\.\\d+)?(e[+-]?\\d+)?$') THEN TRY_CAST(regexp_replace(s, '^m', '') AS DOUBLE) END)"""
P5_FOUND = f"""
WITH l AS (SELECT feed, file_no, rec_no, arg_max(record, struct_pack(r := received_at, x := record)) AS record FROM dxsum_exports WHERE feed IS NOT NULL AND file_no IS NOT NULL GROUP BY ALL),
k AS (SELECT feed, file_no, rec_no, record, unnest(json_keys(record)) AS field FROM l WHERE json_valid(record)), j AS (SELECT feed, file_no, rec_no, field, json_extract(record, '$."' || field || '"') AS j FROM k),
t AS (SELECT feed, file_no, rec_no, field, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind, lower(trim(j ->> '$')) AS s FROM j),
c AS (SELECT feed, file_no, rec_no, field, kind, CASE WHEN kind IS NOT NULL THEN coalesce('d' || {_DAY}, 'n' || {_NUMBER}, s) END AS v FROM (SELECT *, regexp_replace(s, '\\.0+$', '') AS n FROM t)),
n AS (SELECT feed, file_no, field, kind, count(*) AS c FROM c GROUP BY ALL), f AS (SELECT feed, file_no, field, CASE WHEN count(kind) = 0 THEN NULL WHEN bool_and(kind IN ('integer', 'decimal')) AND bool_or(kind = 'decimal') THEN 'decimal' ELSE arg_max(kind, struct_pack(c := c, k := -ascii(kind))) END AS kind FROM n GROUP BY ALL),
p AS (SELECT DISTINCT a.feed, a.file_no FROM f a JOIN f b ON a.feed = b.feed AND a.file_no = b.file_no + 1),
g AS (SELECT p.feed, p.file_no, a.field, a.kind FROM p JOIN f a ON a.feed = p.feed AND a.file_no = p.file_no - 1 WHERE NOT EXISTS (FROM f b WHERE b.feed = p.feed AND b.file_no = p.file_no AND b.field = a.field)),
m AS (SELECT p.feed, p.file_no, a.field, a.kind FROM p JOIN f a ON a.feed = p.feed AND a.file_no = p.file_no WHERE NOT EXISTS (FROM f b WHERE b.feed = p.feed AND b.file_no = p.file_no - 1 AND b.field = a.field)),
h AS (SELECT g.feed, g.file_no, g.field AS prior_field, m.field, any_value(g.kind) AS k0, any_value(m.kind) AS k1, count(*) AS n FROM g JOIN m USING (feed, file_no) JOIN c x ON x.feed = g.feed AND x.file_no = g.file_no - 1 AND x.field = g.field JOIN c y ON y.feed = g.feed AND y.file_no = g.file_no AND y.field = m.field AND y.rec_no = x.rec_no WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY ALL HAVING bool_and(x.v = y.v)),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY feed, file_no, prior_field ORDER BY n DESC, jaro_similarity(lower(prior_field), lower(field)) DESC) = 1 AND row_number() OVER (PARTITION BY feed, file_no, field ORDER BY n DESC, jaro_similarity(lower(prior_field), lower(field)) DESC) = 1),
s AS (SELECT m.feed, m.file_no, a.field, a.kind AS k0, b.kind AS k1 FROM p m JOIN f a ON a.feed = m.feed AND a.file_no = m.file_no - 1 JOIN f b ON b.feed = m.feed AND b.file_no = m.file_no AND b.field = a.field)
SELECT feed, file_no, 'renamed' AS change, field, prior_field FROM r
UNION ALL SELECT feed, file_no, 'removed', field, field FROM g WHERE NOT EXISTS (FROM r WHERE r.feed = g.feed AND r.file_no = g.file_no AND r.prior_field = g.field)
UNION ALL SELECT feed, file_no, 'added', field, field FROM m WHERE NOT EXISTS (FROM r WHERE r.feed = m.feed AND r.file_no = m.file_no AND r.field = m.field)
UNION ALL SELECT feed, file_no, 'retyped', field, field FROM s WHERE k0 <> k1
UNION ALL SELECT feed, file_no, 'retyped', field, prior_field FROM r WHERE k0 <> k1
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "dxsum_exports"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "dxsum_exports"), table(spark, d, "dxsum").schema)


QUERIES = {"p2_found": p2_found, "p2_history": p2_history, "p2_attributes": p2_attributes, "p3_found": p3_found, "p3_cross_sectional": p3_cross_sectional, "p3_longitudinal": p3_longitudinal, "p5_found": p5_found, "p5_unified": p5_unified}
SQL = {"p2_found": P2_FOUND, "p2_history": P2_HISTORY, "p2_attributes": P2_ATTRIBUTES, "p3_found": P3_FOUND, "p3_cross_sectional": P3_CROSS, "p3_longitudinal": P3_LONG, "p5_found": P5_FOUND}
