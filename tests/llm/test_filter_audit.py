import re
from itertools import permutations

import duckdb
import numpy as np
from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm.filter_audit import audit, filter_audit, oracle, potential, worth

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    """(id, text, part) rows by removing documents one filter at a time."""
    seen = {}
    for i, t, _ in rows:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    docs = {}
    for i, text, part in rows:
        t, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > seen[t],
        }
        marks = [m for m in labels if i is not None and m[0] == i]
        docs.setdefault(part or "", []).append(
            (fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks))
        )
    out, total = {}, {}
    for part, each in docs.items():
        for order in permutations("ABCDE"):
            left = each
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in each if d[0][f]]
                alone = [d for d in failing if sum(d[0].values()) == 1]
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), len(failing) - len(gone), len(alone),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def by_key(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


ROWS = [
    *[(i, t, p) for (i, t, _), p in zip(TEXTS, ["en", "de", "en", None, "", "en", "en", "de", "de", "en"])],
    *[(100 + i, "Same text over and over | " * 3, "en" if i % 3 else "de") for i in range(60)],
    (100, "Same text over and over | " * 3, "en"),
    (None, "Same text over and over | " * 3, "fr"),
    (7, " ".join(f"w{i}" for i in range(250)), "en"),
    (9, "a $ b", "en"),
]
GIVEN = [(1, 1, 0), (1, 0, 1), (8, 1, 1), (9, None, 1), (None, 1, 1), (101, 1, None), (140, 0, 1), (150, 1, 1)]


def test_every_order_equals_removing_documents_one_by_one(spark):
    docs = odd_documents(spark, [(i, t, None) for i, t, _ in ROWS]).drop("lang")
    parts = spark.createDataFrame([(i, t, p) for i, t, p in ROWS], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(GIVEN, LABELS)
    want = plain_audit(ROWS, GIVEN)
    assert by_key(filter_audit(parts.withColumns({c: F.lit("x") for c in ("id", "h", "part", "mask", "n")}), labels)) == want
    # whichever column names the parts; a constant one puts all rows in one
    whole_table = filter_audit(docs.withColumn("all", F.lit(7)), labels, part_col="all")
    assert by_key(whole_table) == plain_audit([(i, t, "7") for i, t, _ in ROWS], GIVEN)


def test_tables_equal_sql(spark):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = filter_audit(docs.repartition(13), labels)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(con.execute(oracle()).fetchall()) and got
    assert found.columns == [c[0] for c in con.description]


def test_potential_gives_the_shapley_value(spark):
    rng = np.random.default_rng(3)
    counts = [("p", m, int(rng.integers(1, 50)), 0, 0) for m in range(16)]
    v = [sum(n for _, m, n, _, _ in counts if m & s) for s in range(16)]
    maps = spark.createDataFrame([({m: n for _, m, n, _, _ in counts},)], "c map<int,long>")
    row = maps.select(worth(F.col("c"), 4).alias("v")).withColumn("p", potential(F.col("v"), 4)).first()
    assert row.v == v
    frame = spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")
    got = {r.filter_order[r.step - 1]: r.shapley for r in audit(frame, "WXYZ").collect()}
    for i, letter in enumerate("WXYZ"):
        want = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[: order.index(i)])
            want += v[before | 1 << i] - v[before]
        assert got[letter] == want == row.p[15] - 4 * row.p[15 - (1 << i)]
    assert sum(got.values()) == 24 * v[15]


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(no_documents(spark), none).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = filter_audit(one, none).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {r.removed for r in rows if r.step == 1 and r.filter_order[0] == "A"} == {1}
