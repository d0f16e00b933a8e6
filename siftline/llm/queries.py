"""Queries p1, p4, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import mixture, nearest, pieces, splits, tokenizer
from siftline.operators.components import components
from siftline.session import beside, cut, spread, table
from siftline.sources.clinical import current_visits, oasis_key, oasis_subject


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    raw, plasma = table(spark, d, "dxsum"), table(spark, d, "upenn_plasma")
    draws = plasma.where("pT217_F >= 0 and not isnan(pT217_F)")
    return nearest.nearest_join(draws, current_visits(raw), "RID", "EXAMDATE", "DRAW_ID", "ID", 14 * 24 * 3600, (plasma, raw))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("right_id").alias("visit_id"), F.col("left_id").alias("draw_id"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the visit's state, the draw's value and the hours between."""
    p = _pairs(spark, d).select(F.col("left_id").alias("DRAW_ID"), F.col("right_id").alias("ID"), (F.col("gap") / 3_600_000_000).alias("gap_hours"))
    visits, draws = table(spark, d, "dxsum").select("ID", "RID", "VISCODE2", "DIAGNOSIS"), table(spark, d, "upenn_plasma").select("DRAW_ID", "pT217_F")
    return p.join(visits, "ID").join(draws, "DRAW_ID").select("RID", "VISCODE2", "DIAGNOSIS", "pT217_F", F.round("gap_hours", 6).alias("gap_hours"), F.col("ID").alias("visit_id"), F.col("DRAW_ID").alias("draw_id"))


P1_PAIRS = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RID, VISCODE2 ORDER BY update_stamp DESC, ID) k FROM dxsum) WHERE k = 1 AND EXAMDATE IS NOT NULL),
p AS (SELECT c.*, DRAW_ID, pT217_F, abs(epoch_us(u.EXAMDATE) - epoch_us(c.EXAMDATE)) AS gap, row_number() OVER (PARTITION BY DRAW_ID ORDER BY abs(epoch_us(u.EXAMDATE) - epoch_us(c.EXAMDATE)), c.EXAMDATE, c.ID) AS n
 FROM upenn_plasma u JOIN cur c USING (RID) WHERE pT217_F >= 0 AND NOT isnan(pT217_F) AND abs(epoch_us(u.EXAMDATE) - epoch_us(c.EXAMDATE)) <= 1209600000000)
"""
P1_FOUND = P1_PAIRS + "SELECT ID AS visit_id, DRAW_ID AS draw_id FROM p WHERE n = 1"
P1_PAIRS += "SELECT RID, VISCODE2, DIAGNOSIS, pT217_F, round(gap / 3600000000, 6) AS gap_hours, ID AS visit_id, DRAW_ID AS draw_id FROM p WHERE n = 1"


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables: cohort, record, subject (as written), component, label.

    A subject's rows share their key without any link, so the graph has only the links between different keys: what
    cross-references say, and of a subject with several sites the first with each other one. A row of adni without
    site is where its subject is; a row without any id is by itself.
    """
    o = table(spark, d, "oasis_longitudinal")
    own, said = oasis_key(oasis_subject(F.col("MRI ID"))), oasis_key(F.col("Subject ID"))
    raw = F.concat(F.lit("text:"), F.col("Subject ID"))
    o = o.select(F.lit("oasis").alias("cohort"), F.col("MRI ID").alias("record"), F.col("Subject ID").alias("subject"), F.coalesce(said, own, raw, F.concat(F.lit("row:"), F.xxhash64(*(f"`{c}`" for c in o.columns)).cast("string"))).alias("node"), own.alias("other"), F.col("Group").alias("label"))
    c = table(spark, d, "adni_contract")
    named = F.coalesce(F.concat(F.lit("subject:"), F.col("subject_id")), F.concat(F.lit("row:"), F.xxhash64(*c.columns).cast("string")))
    c = c.select(F.lit("adni").alias("cohort"), F.col("subject_id").alias("record"), F.col("subject_id").alias("subject"), named.alias("of"), F.concat(F.lit("site:"), F.col("site")).alias("node"), F.col("dx").alias("label"))
    seen = c.where("node is not null").select("of", "node").distinct()
    home = seen.groupBy("of").agg(F.min("node").alias("home"))
    lost = c.where("node is null").drop("node").join(home, "of", "left").withColumn("node", F.coalesce("home", "of"))
    cols = ["cohort", "record", "subject", "node", "label"]
    rows = o.select(cols).unionByName(c.where("node is not null").select(cols)).unionByName(lost.select(cols))
    x = table(spark, d, "subject_xref")
    links = x.select(F.lit("oasis").alias("cohort"), oasis_key(F.col("subject_a")).alias("a"), oasis_key(F.col("subject_b")).alias("b"))
    links = links.union(o.where("node <> other").select("cohort", "node", "other").distinct()).union(seen.join(home, "of").where("node <> home").select(F.lit("adni"), "home", "node").distinct())
    prefixed = lambda c: F.concat("cohort", F.lit("/"), c)  # noqa: E731  (null stays null: a null side is no link)
    found = components(links.select(prefixed("a").alias("a"), prefixed("b").alias("b")))
    return rows.withColumn("node", prefixed("node")).join(found, "node", "left").select("cohort", "record", "subject", F.coalesce("component", "node").alias("component"), "label")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    r = cut(_related(spark, d))
    return r.join(splits.assign_splits(r, table(spark, d, "split_targets")), ["cohort", "component"]).select("cohort", "record", "subject", "component", "split")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = p4_splits(spark, d).where("cohort = 'oasis' and subject is not null").select("component", "split", "subject").distinct()
    return s.select("component", "split", F.col("subject").alias("subject_a")).join(s.select("component", "split", F.col("subject").alias("subject_b")), ["component", "split"]).where("subject_a < subject_b").select("subject_a", "subject_b")


_KEY = "'OAS' || regexp_extract({0}, '(?i)OAS([12])', 1) || '_' || CAST(CAST(regexp_extract({0}, '(?i)OAS[12][^0-9a-zA-Z]*([0-9]+)', 1) AS BIGINT) AS VARCHAR)"
P4_FOUND = f"""
WITH RECURSIVE s AS (SELECT DISTINCT "Subject ID" AS subject, {_KEY.format('"Subject ID"')} AS k FROM oasis_longitudinal WHERE "Subject ID" IS NOT NULL),
x AS (SELECT DISTINCT {_KEY.format('subject_a')} AS a, {_KEY.format('subject_b')} AS b FROM subject_xref WHERE subject_a IS NOT NULL AND subject_b IS NOT NULL),
e AS (SELECT a, b FROM x UNION SELECT b, a FROM x), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
j AS (SELECT a, b FROM r UNION SELECT k, k FROM s)
SELECT DISTINCT p.subject AS subject_a, q.subject AS subject_b FROM s p JOIN j ON p.k = j.a JOIN s q ON q.k = j.b WHERE p.subject < q.subject
"""


def p4_components(spark: SparkSession, d: str) -> DataFrame:
    """How many components of each size a cohort has, and in how many splits the rows of one lie at most."""
    c = p4_splits(spark, d).groupBy("cohort", "component").agg(F.count("*").alias("rows"), F.count_distinct("split").alias("splits"))
    return c.groupBy("cohort", "rows").agg(F.count("*").alias("components"), F.max("splits").alias("splits"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """cohort, split, share, total rows, and whether the split's rows are within one row, or within the largest component if that is due to it, of what is due."""
    s = cut(p4_splits(spark, d))
    whole = s.groupBy("cohort", "component").agg(F.count("*").alias("n")).groupBy("cohort").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    got = s.groupBy("cohort", "split").agg(F.count("*").alias("rows"))
    targets = table(spark, d, "split_targets").agg(F.collect_list(F.struct("split", "share")).alias("targets"))  # a few splits
    r = beside(whole, targets).select("*", F.inline("targets")).join(got, ["cohort", "split"], "left")
    return r.select("cohort", "split", "share", "total", (F.abs(F.coalesce("rows", F.lit(0)) - F.col("share") * F.col("total")) <= F.greatest(F.lit(1), F.col("largest") / 2)).alias("near"))


P4_COMPONENTS = f"""
WITH RECURSIVE o AS (SELECT coalesce({_KEY.format('"Subject ID"')}, {_KEY.format('"MRI ID"')}) AS k FROM oasis_longitudinal),
x AS (SELECT DISTINCT {_KEY.format('subject_a')} AS a, {_KEY.format('subject_b')} AS b FROM subject_xref WHERE subject_a IS NOT NULL AND subject_b IS NOT NULL),
e AS (SELECT a, b FROM x UNION SELECT b, a FROM x), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), oc AS (SELECT coalesce(m.c, o.k) AS c, count(*) AS rows FROM o LEFT JOIN m ON m.a = o.k GROUP BY 1),
t AS (SELECT coalesce('subject:' || subject_id, 'row:' || hash(adni_contract::VARCHAR)) AS s, 'site:' || site AS site FROM adni_contract), h AS (SELECT s, min(site) AS home FROM t GROUP BY s),
f AS (SELECT DISTINCT home AS a, site AS b FROM t JOIN h USING (s) WHERE site IS NOT NULL), g AS (SELECT a, b FROM f UNION SELECT b, a FROM f), q(a, b) AS (SELECT a, b FROM g UNION SELECT q.a, g.b FROM q JOIN g ON q.b = g.a),
n AS (SELECT a, least(a, min(b)) AS c FROM q GROUP BY a), ac AS (SELECT coalesce(n.c, t.site, h.home, t.s) AS c, count(*) AS rows FROM t JOIN h USING (s) LEFT JOIN n ON n.a = coalesce(t.site, h.home) GROUP BY 1)
SELECT 'oasis' AS cohort, rows, count(*) AS components, 1::BIGINT AS splits FROM oc GROUP BY rows UNION ALL SELECT 'adni', rows, count(*), 1 FROM ac GROUP BY rows
"""
P4_SHARES = "SELECT cohort, split, share, total, true AS near FROM (SELECT 'oasis' AS cohort, count(*) AS total FROM oasis_longitudinal UNION ALL SELECT 'adni', count(*) FROM adni_contract), split_targets"


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokenizer.encode(F.col("text"), tokenizer.vocabulary(spark)).alias("ids"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    docs, vocab = spread(table(spark, d, "documents").select("doc_id", "text")), tokenizer.vocabulary(spark)
    ids = tokenizer.encode(F.col("text"), vocab)
    return docs.select("doc_id", ids.alias("ids"), "text").select("doc_id", F.size("ids").alias("n"), (tokenizer.decode(F.col("ids"), vocab) == F.coalesce("text", F.lit(""))).alias("same"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return cut(docs.select(F.col("doc_id").alias("id"), "source", tokenizer.count_tokens(F.col("text"), tokenizer.vocabulary(spark)).alias("tokens")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_sizes(spark, d), table(spark, d, "mix_targets")).select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    return mixture.reached(sizes, targets, mixture.mix(sizes, targets))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return pieces.cut_texts(docs, "text", tokenizer.vocabulary(spark)).select("doc_id", "piece", "first", "tokens", "boundary", "piece_text")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back, byte for byte, from its ids; a null text from none."""
    return p6_decoded(spark, d).select("doc_id", "same")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """A row a target: whether no document is used too often, and whether its tokens are within 0.1 % of what is due, or within half of its smallest document."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    least = sizes.where("tokens > 0").groupBy("source").agg(F.min("tokens").alias("least"))
    r = mixture.reached(sizes, targets, mixture.mix(sizes, targets)).join(least, "source", "left")
    return r.select("source", "weight", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("mixed") - F.col("due")) <= F.greatest(F.col("due") / 1000, F.coalesce("least", F.lit(0)) / 2 + 1)).alias("near"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """A row a document with text: whether no piece is over 512 tokens, consecutive ones share 64 tokens or the few more that complete a character, and each begins where the shared tokens do, up to the end of the text."""
    w = Window.partitionBy("doc_id").orderBy("piece")  # the pieces of one text
    p = p8_pieces(spark, d).withColumn("shared", F.lag(F.col("first") + F.col("tokens")).over(w) - F.col("first"))
    # F.lag is null for a first piece, which begins at 0
    ok = F.when(F.col("piece") == 0, F.col("first") == 0).otherwise(F.col("shared").between(64, 67))
    return p.groupBy("doc_id").agg((F.max("tokens") <= 512).alias("small"), F.min(ok).alias("overlapping"), (F.max_by("boundary", "piece") == "end").alias("whole"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).where("piece = 1").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p4_found": p4_found, "p4_splits": p4_splits, "p4_components": p4_components, "p4_shares": p4_shares, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p6_roundtrip": p6_roundtrip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_checks": p8_checks}
SQL = {"p1_found": P1_FOUND, "p1_pairs": P1_PAIRS, "p4_found": P4_FOUND, "p4_components": P4_COMPONENTS, "p4_shares": P4_SHARES}
SQL |= {
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p7_checks": "SELECT source, weight, max_repeats, true AS capped, true AS near FROM mix_targets",
    "p8_checks": "SELECT doc_id, true AS small, true AS overlapping, true AS whole FROM documents WHERE text IS NOT NULL",
}
