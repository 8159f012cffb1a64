from datetime import datetime as dt

from gneiss.operators import references
from gneiss.operators.skew import hot_keys, lookup

T = [dt(2024, 1, d) for d in range(1, 29)]


def brute(refs, parents):
    out = []
    for i, k, created, arrived in refs:
        if k is None:
            continue
        mine = [p for p in parents if p[0] == k]
        if not mine:
            out.append((i, k, "missing"))
            continue
        gone = max(mine, key=lambda p: (p[1], p[2] is not None, p[2] or T[0]))[2]
        if gone is not None and created is not None and gone <= created:
            out.append((i, k, "deleted"))
        elif arrived is not None and min(p[1] for p in mine) > arrived:
            out.append((i, k, "late"))
    return sorted(out, key=str)


def test_kinds_and_hot_keys(spark):
    parents = [("a", T[2], None), ("a", T[9], None), ("hot", T[5], T[10]), ("c", T[20], None), (None, T[0], None)]
    refs = [(f"i{n}", "hot", T[n % 20], T[n % 20]) for n in range(300)] + [("x", "a", T[0], T[0]), ("y", "a", T[3], T[3]), ("z", "gone", T[3], T[3]), ("n", None, T[0], T[0]), ("m", "c", None, None), ("o", "c", T[25], T[25]), ("p", "c", T[1], T[1])]
    r = spark.createDataFrame(refs, "inquiry_id string, ref_key string, ref_created timestamp, ref_arrived timestamp")
    p = references.parent_intervals(spark.createDataFrame(parents, "k string, loaded timestamp, deleted timestamp"), "k", "loaded", "deleted")
    assert hot_keys(r, "ref_key") == ["hot", "c"] or set(hot_keys(r, "ref_key", 0.1)) == {"hot"}
    for share in (0.1, 2.0):  # with and without hot keys
        got = sorted([(x.inquiry_id, x.ref_key, x.kind) for x in references.orphans(r, p, share).collect()], key=str)
        assert got == brute(refs, parents)


def test_empty(spark):
    r = spark.createDataFrame([], "inquiry_id string, ref_key string, ref_created timestamp, ref_arrived timestamp")
    p = references.parent_intervals(spark.createDataFrame([], "k string, loaded timestamp, deleted timestamp"), "k", "loaded", "deleted")
    assert references.orphans(r, p).count() == 0


def test_lookup_keeps_all_rows(spark):
    rows = spark.createDataFrame([(n, "h" if n % 3 else str(n)) for n in range(99)] + [(99, None)], "n int, k string")
    unique = spark.createDataFrame([("h", 1), ("3", 2)], "u string, v int")
    assert lookup(rows, unique, "k", "u").count() == 100
    assert lookup(rows, unique, "k", "u", how="inner").count() == 67
