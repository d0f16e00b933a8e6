"""Readers of the raw file formats, as Spark jobs over any number of files.

Text formats are read line by line with the file's path as key, and what belongs to a file is found by
aggregation or windows over its lines; binary ones by binaryFile and Arrow batches, one file a row. Missing
fields are null, unreadable lines are left out, and an empty folder gives an empty table of the same schema.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header; comment lines skipped; without a schema all columns are strings."""
    r = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    return (r.schema(schema) if schema else r).csv(path)


def strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, nulls as empty text."""
    return csv(spark, path, sep=sep).na.fill("")


def strict(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Delimited text whose short or unreadable rows are dropped."""
    return spark.read.option("header", header).option("sep", sep).option("mode", "DROPMALFORMED").schema(schema).csv(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w from a CSV of gene_a, gene_b, combined_score with "#" lines; loops and unreadable rows dropped."""
    e = csv(spark, path, comment="#")
    return e.select(F.col("gene_a").alias("src"), F.col("gene_b").alias("dst"), F.col("combined_score").try_cast("double").alias("w")).where("src <> dst and w is not null")


def snapshot(spark: SparkSession, path: str, field: str) -> DataFrame:
    """key, value (JSON text) of an object within a JSON file: {field: {key: value}}; no rows if it is missing."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.map_entries(F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,string>"))).alias("e")).select("e.key", "e.value")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_id, name, item from a JSON file {gene_sets: [{id, name, genes: []}]}."""
    t = spark.read.text(path, wholetext=True)
    sets = F.from_json(F.get_json_object("value", "$.gene_sets"), "array<struct<id: string, name: string, genes: array<string>>>")
    return t.select(F.explode(sets).alias("s")).select(F.col("s.id").alias("set_id"), "s.name", F.explode("s.genes").alias("item"))


def html_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a table that a page keeps as JSON columns: the first "data":[[...],[...]] is turned and stripped of tags."""
    t = spark.read.text(path, wholetext=True)
    cols = F.from_json(F.regexp_extract("value", r'(?s)"data"\s*:\s*(\[\s*\[.*?\]\s*\])', 1), "array<array<string>>")
    t = t.select(cols.alias("c")).where("c is not null")
    z = F.arrays_zip(*(F.transform(F.get("c", i), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))).alias(n) for i, n in enumerate(names)))
    return t.select(F.inline(z))


def segment_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, icv, brain, hippocampus, ventricles: "# Measure" headers and sums of both hemispheres of the table of a segmentation's statistics."""
    return segment_lines(spark.read.text(path).select(F.input_file_name().alias("file"), "value"))


def segment_lines(lines: DataFrame) -> DataFrame:
    """The same from the lines (file, value) of any number of files."""
    t = lines.select("file", F.trim("value").alias("l"))
    m = F.when(F.col("l").startswith("# Measure"), F.split("l", r",\s*"))
    f = F.when(~F.col("l").startswith("#"), F.split("l", r"\s+"))
    t = t.select("file", F.regexp_replace(F.get(m, 0), r"^# Measure\s+", "").alias("measure"), F.get(m, 3).try_cast("double").alias("amount"), F.get(f, 4).alias("part"), F.get(f, 3).try_cast("double").alias("volume"))
    pick = lambda c, on, names: F.sum(F.when(F.col(on).isin(names), F.col(c)))
    return t.groupBy("file").agg(
        pick("amount", "measure", ["EstimatedTotalIntraCranialVol"]).alias("icv"), pick("amount", "measure", ["BrainSeg"]).alias("brain"),
        pick("volume", "part", ["Left-Hippocampus", "Right-Hippocampus"]).alias("hippocampus"), pick("volume", "part", ["Left-Lateral-Ventricle", "Right-Lateral-Ventricle"]).alias("ventricles"),
    )


def structure_confidence(spark: SparkSession, path: str) -> DataFrame:
    """file, atoms, confidence: the mean B factor over CA atoms of mmCIF files, columns by each file's own header."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("l"))
    head = t.where(F.col("l").startswith("_atom_site.")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", F.substring_index("l", ".", -1).alias("c")))).alias("h")).select("file", F.col("h.c").alias("h"))
    a = t.where(F.col("l").startswith("ATOM")).join(head, "file").select("file", F.map_from_arrays("h", F.slice(F.split("l", r"\s+"), F.lit(1), F.size("h"))).alias("m"))
    return a.where(F.try_element_at("m", F.lit("label_atom_id")) == "CA").groupBy("file").agg(F.count("*").alias("atoms"), F.avg(F.try_element_at("m", F.lit("B_iso_or_equiv")).try_cast("double")).alias("confidence"))


def archive_fields(spark: SparkSession, path: str, inside: str, key: str, fields: list[str]) -> DataFrame:
    """key and fields from XML files in zip archives whose inner path matches; of several values of a key the first by path that isn't empty."""
    schema = ", ".join(f"`{c}` string" for c in ["inner", key, *fields])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if re.search(inside, name):
                            first: dict[str, str] = {}
                            for e in ElementTree.fromstring(z.read(name)).iter():
                                tag = e.tag.rpartition("}")[2]
                                if e.text and e.text.strip():
                                    first.setdefault(tag, e.text.strip())
                            rows.append([name, *(first.get(c) for c in [key, *fields])])
            yield pd.DataFrame(rows, columns=["inner", key, *fields])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("inner"))).alias(c)
    return raw.where(F.col(key).isNotNull()).groupBy(key).agg(*(first(c) for c in fields))


def front_matter(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a small Markdown policy: "key: value" lines between the first two "---" lines; {} without any."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1).alias("h")).limit(1).collect()
    return dict(re.findall(r"(?m)^([\w.-]+):[ \t]*(.*?)[ \t]*$", rows[0]["h"])) if rows else {}


VOLUME = "path string, site string, dims array<int>, spacing array<double>, sform int, qform int, axes string, qaxes string, median double, finite boolean, constant boolean, dead_slices int, lo array<int>, hi array<int>, centroid array<double>, histogram array<bigint>, problem string"


def volumes(spark: SparkSession, path: str, site: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """A row a NIfTI file (gzipped or not): header, foreground box and centroid in world units, intensity summary; site is the path's folder.

    A file that can't be read gets a problem and nulls.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_volume(p, c, site) for p, c in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in VOLUME.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, VOLUME)


def _axes(m: np.ndarray) -> str:
    out = ""
    for col in m[:, :3].T:
        i = int(np.abs(col).argmax())
        out += "RAS"[i] if col[i] > 0 else "LPI"[i]
    return out


def _volume(path: str, content: bytes, site: str) -> list:
    where = re.search(site, path)
    out: list = [path, where.group(1) if where else None]
    try:
        raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
        dim = struct.unpack_from(f"{order}8h", raw, 40)
        kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[struct.unpack_from(f"{order}h", raw, 70)[0]]
        pix = struct.unpack_from(f"{order}8f", raw, 76)
        slope, inter = struct.unpack_from(f"{order}2f", raw, 112)
        qform, sform = struct.unpack_from(f"{order}2h", raw, 252)
        b, c, d, x, y, z = struct.unpack_from(f"{order}6f", raw, 256)
        rows = np.array(struct.unpack_from(f"{order}12f", raw, 280)).reshape(3, 4)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        q = np.column_stack([turn * np.array([pix[1], pix[2], pix[3] * (pix[0] or 1)]), [x, y, z]])
        dims = [int(v) for v in dim[1 : 1 + dim[0]]]
        v = np.frombuffer(raw, order + kind, int(np.prod(dims)), int(struct.unpack_from(f"{order}f", raw, 108)[0])).reshape(dims, order="F").astype(float)
        v = v * slope + inter if slope else v
        finite = bool(np.isfinite(v).all())
        w = np.nan_to_num(v)
        on = w > 0.02 * np.percentile(w, 99)
        at = np.argwhere(on)
        affine = rows if sform else q
        dead = 0
        if w.ndim == 3:
            inner = [w[:, :, k] for k in range(w.shape[2] // 4, w.shape[2] - w.shape[2] // 4)]
            dead = sum(float(s.std()) == 0 for s in inner)
        lo, hi = (at.min(0).tolist(), at.max(0).tolist()) if len(at) else (None, None)
        mid = (affine[:, :3] @ np.pad(at.mean(0), (0, max(0, 3 - w.ndim)))[:3] + affine[:, 3]).tolist() if len(at) else None
        hist = np.histogram(w[on], 60, (0, np.percentile(w, 99) or 1))[0].tolist() if len(at) else None
        return [*out, dims, [float(s) for s in pix[1 : 1 + dim[0]]], int(sform), int(qform), _axes(rows) if sform else None, _axes(q) if qform else None, float(np.median(w[on])) if len(at) else None, finite, bool(w.std() == 0), dead, lo, hi, mid, hist, None]
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        return [*out, *[None] * 14, f"{type(e).__name__}: {e}"[:200]]
