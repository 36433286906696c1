"""Distinct counts from merged sketches against exact ones."""

from codescope.operators.sketches import distinct_sketches, merged_counts
from codescope.session import written


def test_merged_sketches(spark):
    data = [(f"p{i % 3}" if i % 2 else "hot", i % 40, f"f{(i * i) % 9973}", None if i % 5 else i) for i in range(20_000)]
    df = spark.createDataFrame(data, "project STRING, symbol_id INT, path STRING, caller INT")
    stored = written(distinct_sketches(df, ["project", "symbol_id"], ["path", "caller"]), "sketches")
    for keys, of in ((["project"], lambda r: (r[0],)), ([], lambda r: ())):
        found = {tuple(r[k] for k in keys): (r.n_path, r.n_caller) for r in merged_counts(stored, keys, ["path", "caller"]).collect()}
        assert set(found) == {of(r) for r in data}
        for key, counts in found.items():
            for i, n in zip((2, 3), counts):
                exact = len({r[i] for r in data if of(r) == key and r[i] is not None})
                assert abs(n - exact) <= 0.04 * exact
    nothing = spark.createDataFrame([("p", None)], "project STRING, path STRING")
    assert merged_counts(distinct_sketches(nothing, ["project"], ["path"]), ["project"], ["path"]).first().n_path == 0
    assert merged_counts(distinct_sketches(nothing.limit(0), ["project"], ["path"]), ["project"], ["path"]).count() == 0
