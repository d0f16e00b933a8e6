"""Schema drift against a brute-force version on the smallest table, and defined cases."""

import datetime
import itertools
import json
from collections import Counter, defaultdict

import pyarrow.dataset as ds
import pytest

from siftline.operators import drift

MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13), strict=True))


def canon(v):
    if isinstance(v, bool):
        return float(v)
    s = str(v).strip().lower()
    for known, n in {"cn": 1, "mci": 2, "dementia": 3, "true": 1, "false": 0}.items():
        if s == known:
            return float(n)
    if len(s) >= 10 and s[4] == s[7] == "-" and s[:4].isdigit():
        return datetime.date.fromisoformat(s[:10])
    if s.count("/") == 2:
        m, d, y = map(int, s.split("/"))
        return datetime.date(y, m, d)
    if len(s) == 9 and s[2:5] in MONTHS:
        return datetime.date(int(s[5:]), MONTHS[s[2:5]], int(s[:2]))
    n = s[1:] if s[:1] == "m" else s
    try:
        x = float(n)
    except ValueError:
        return s
    if x == int(x):
        if len(str(int(x))) == 8 and str(int(x))[:2] in ("19", "20") and s[0] != "0":
            return datetime.datetime.strptime(str(int(x)), "%Y%m%d").date()
        if len(str(int(x))) in (9, 10):
            return datetime.datetime.fromtimestamp(x, datetime.UTC).date()
        if len(str(int(x))) in (12, 13):
            return datetime.datetime.fromtimestamp(x / 1000, datetime.UTC).date()
    return x


def kind(values):
    kinds = Counter({str: "string", bool: "boolean", int: "integer", float: "decimal"}[type(v)] for v in values if v is not None)
    if set(kinds) == {"integer", "decimal"}:
        return "decimal"
    return min(kinds, key=lambda k: (-kinds[k], k)) if kinds else None


def brute(rows):
    files = defaultdict(dict)
    for feed, no, rec, text in rows:
        files[feed, no][rec] = json.loads(text)
    out = set()
    for (feed, no), now in files.items():
        was = files.get((feed, no - 1))
        if was is None:
            continue
        a, b = ({k for r in f.values() for k in r} for f in (was, now))
        kinds = [{k: kind(r.get(k) for r in f.values()) for k in names} for f, names in ((was, a), (now, b))]
        gone, came, pairs = a - b, b - a, []
        for g, c in itertools.product(sorted(gone), sorted(came)):
            both = [(was[r][g], now[r][c]) for r in was.keys() & now.keys() if was[r].get(g) is not None and now[r].get(c) is not None]
            if both and all(canon(x) == canon(y) for x, y in both):
                pairs.append((g, c))
        assert len({g for g, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        for g, c in pairs:
            out.add((feed, no, "renamed", c, g))
        for g in gone - {g for g, _ in pairs}:
            out.add((feed, no, "removed", g, g))
        for c in came - {c for _, c in pairs}:
            out.add((feed, no, "added", c, c))
        for g, c in [*pairs, *((k, k) for k in a & b)]:
            x, y = kinds[0][g], kinds[1][c]
            if x and y and x != y:
                out.add((feed, no, "retyped", c, g))
    return out


def exports(spark, rows):
    t = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([(f, n, t, r, x if isinstance(x, str) or x is None else json.dumps(x)) for f, n, r, x in rows], "feed string, file_no int, received_at timestamp, rec_no int, record string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_changes_as_brute_force(spark, sf):
    path = f"/root/testdata/{sf}/dxsum_exports.parquet"
    rows = [tuple(r.values()) for r in ds.dataset(path).to_table(columns=["feed", "file_no", "rec_no", "record"]).to_pylist()]
    got = {tuple(r) for r in drift.changes(spark.read.parquet(path)).collect()}
    assert got == brute(rows) and got


def test_defined_cases(spark):
    a = [("f", 1, i, {"x": i, "gone": 7, "D": "2020-01-0%d" % i, "n": None}) for i in (1, 2, 3)]
    b = [("f", 2, i, {"X Y": float(i), "D": 1577836800 + 86400 * (i - 1), "new": i % 2 == 0, "n": None}) for i in (1, 2, 3, 4)]
    c = [("f", 4, 1, {"other": 1}), ("g", 1, 1, None), ("g", 1, 2, "{bad"), ("g", 1, 3, "[1]"), ("g", 2, 1, {"a": [1]})]
    got = {tuple(r) for r in drift.changes(exports(spark, a + b + b + c)).collect()}
    assert got == {("f", 2, "renamed", "X Y", "x"), ("f", 2, "retyped", "X Y", "x"), ("f", 2, "removed", "gone", "gone"), ("f", 2, "added", "new", "new"), ("f", 2, "retyped", "D", "D")}
    assert drift.changes(exports(spark, a).limit(0)).count() == 0


def test_sparse_field(spark):
    # 15 of 3,000 records are filled; the first file writes nulls and the second leaves them out
    a = [("f", 1, i, {"x": 1, "rare": i if i % 200 == 7 else None}) for i in range(3000)]
    b = [("f", 2, i, {"x": 1} | ({"Seldom": str(i)} if i % 200 == 7 else {})) for i in range(3000)]
    assert {tuple(r) for r in drift.changes(exports(spark, a + b)).collect()} == {("f", 2, "renamed", "Seldom", "rare"), ("f", 2, "retyped", "Seldom", "rare")}


def test_near_equal_fields(spark):
    # two flags differ in 1 of 3,000 records, and the other one's name is the likelier
    a = [("f", 1, i, {"flag_a": i % 7, "x": 1}) for i in range(3000)]
    b = [("f", 2, i, {"flag_a_new": 9 if i == 1234 else i % 7, "QQ": i % 7, "x": 1}) for i in range(3000)]
    assert {tuple(r) for r in drift.changes(exports(spark, a + b)).collect()} == {("f", 2, "renamed", "QQ", "flag_a"), ("f", 2, "added", "flag_a_new", "flag_a_new")}


def test_one_common_value(spark):
    # each file fills other records of the field but for one, which no slot need hold
    a = [("f", 1, i, {"old": i if i < 2001 else None, "x": 1}) for i in range(4000)]
    b = [("f", 2, i, {"new": i if i >= 2000 else None, "x": 1}) for i in range(4000)]
    assert {tuple(r) for r in drift.changes(exports(spark, a + b)).collect()} == {("f", 2, "renamed", "new", "old")}


def test_unify(spark):
    target = spark.createDataFrame([], "RID bigint, EXAMDATE timestamp, DIAGNOSIS double, VISCODE2 string").schema
    a = [("f", 1, i, {"RID": i, "EXAMDATE": f"2020-01-0{i}", "DIAGNOSIS": 2, "VISCODE2": "m06", "feed": "x", "NOTE": "a"}) for i in (1, 2)]
    b = [("f", 2, i, {"RID": f"00{i}", "exam.date": f"01/0{i}/2020", "DX": "MCI", "Vis Code 2": 6.0, "NOTE": "a"}) for i in (1, 2)]
    got = drift.unify(exports(spark, a + b), target)
    rows = got.orderBy("file_no", "rec_no").collect()
    assert {"EXAMDATE", "NOTE", "more"} <= set(got.columns) and len(rows) == 4
    for r in rows:
        assert (r["RID"], r["EXAMDATE"].day, r["DIAGNOSIS"], r["VISCODE2"], r["NOTE"]) == (r["rec_no"], r["rec_no"], 2.0, "m06", "a")
    assert rows[0]["more"] == {"feed": "x"} and rows[2]["more"] == {}


def test_assignment_is_best():
    w = [[0.9, 0.8, 0.0], [0.9, 0.1, 0.0]]
    assert drift.assign(w) == [1, 0]
    assert drift.assign([[0.0], [0.5]]) == [-1, 0]


def test_notation_in_any_zone(spark):
    from pyspark.sql import functions as F

    from siftline.functions.notation import canonical, micros, moment

    same = [("2013-09-18T11:22:15", "1379503335"), ("2007-12-13", "12/13/2007"), ("08Apr2006", "2006-04-08T00:00:00"), ("20070331", "1175299200000"), ("m06", "6.0"), ("Dementia", "3"), ("true", "1"), ("003", "3.0"), (" a ", "A")]
    df = spark.createDataFrame(same, "a string, b string")
    for zone in ("America/Sao_Paulo", "Asia/Kathmandu", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert df.where(canonical(F.col("a")) != canonical(F.col("b"))).count() == 0
            t = df.select(moment(F.col("a")).alias("t"))
            assert t.select(micros(t, "t")).first()[0] == 1379503335_000_000
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_recall_of_renames_by_density(spark):
    """Fields filled in 0.1 % to 100 % of 4,000 records, two renames of each density: all are found, and nothing else."""
    import random

    rnd, densities, rows, want = random.Random(11), [0.001, 0.005, 0.05, 0.5, 1.0], [], set()
    for f in range(2):
        feed, old, new = f"f{f}", {}, {}
        for k, d in enumerate(densities):
            for copy in range(1):
                name = f"{k}_{copy}"
                want.add((feed, 2, "renamed", f"new {name}", f"old {name}"))
                for r in rnd.sample(range(4000), round(4000 * d)):
                    v = rnd.randint(0, 10**9)
                    old.setdefault(r, {})[f"old {name}"] = v
                    new.setdefault(r, {})[f"new {name}"] = v
        rows += [(feed, 1, r, x) for r, x in old.items()] + [(feed, 2, r, x) for r, x in new.items()]
    got = {tuple(r) for r in drift.changes(exports(spark, rows)).collect()}
    by = {d: sum(x[3].split()[1][0] == str(k) for x in got & want) / 2 for k, d in enumerate(densities)}
    assert got == want, by
