import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.operators import reject


def scalar_fields(line):
    """One byte at a time: fields and whether the quoting holds."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            v, i = "", i + 1
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        v, i = v + '"', i + 2
                        continue
                    i += 1
                    break
                v, i = v + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return None
        else:
            e = line.find("\t", i)
            e = len(line) if e < 0 else e
            v, i = line[i:e], e
        out.append(v)
        if i >= len(line):
            return out
        i += 1


def test_tokenizer_equals_scalar_machine():
    rng = random.Random(5)
    lines = ["".join(rng.choice('a"\tbé') for _ in range(rng.choice([0, 1, 3, 8, 40, 900]))) for _ in range(800)]
    fields, err = reject.tokenize(pa.array(lines))
    for line, f, e in zip(lines, fields.to_pylist(), err, strict=True):
        want = scalar_fields(line)
        assert (e >= 0) == (want is None), line
        if want is not None:
            assert f == want, line


def test_states_do_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    cls = rng.integers(0, 4, 5000).astype(np.uint8)
    a = reject.byte_states(cls, 7)
    for chunk in (1, 64, 256, 5000, 9999):
        assert (reject.byte_states(cls, chunk) == a).all()
    assert len(reject.byte_states(cls[:0])) == 0


def test_streams_are_cut_between_records(spark, monkeypatch):
    monkeypatch.setattr(reject, "STREAM", 10)
    lines = ["a\t1\t2", "b" * 50 + "\t1\t2", '"c\t1', "d\t3\t4"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(lines)], names=["k0", "__hf_line"])
    out = pa.Table.from_batches(list(reject._tokenizer(["k0"])(iter([batch]))))
    assert out.column("k0").to_pylist() == [0, 1, 2, 3] and out.column("quote_error_at").to_pylist() == [-1, -1, 4, -1]
    assert out.column("fields").to_pylist()[3] == ["d", "3", "4"]


def test_offsets_nulls_and_slices():
    arr = pa.array(["zz", None, 'a\t"b"c', '"open', ""])[1:]
    fields, err = reject.tokenize(arr)
    assert err.tolist() == [-1, 5, 5, -1] and fields.to_pylist()[0] == [""]


def test_reasons(spark):
    gaf = "\t".join(["x"] * 4 + ["GO:0001234"] + ["y"] * 12)
    rows = [
        ("bed", "chr1\t1\t2\r", None), ("bed", "chr1\t1", "columns"), ("bed", "chr1\t5\t2", "value"), ("bed", "chr1\t+1\t2", "value"),
        ("bed", "chr1\t1\t9223372036854775808", "value"), ("bed", 'chr1\t1\t2\t"a', "quoting"), ("bed", 'chr1\t"1"\t2', None), ("bed", 'chr1\t1\t2\t"a"b', "quoting"),
        ("bed", "chr1\t00000000000000000000001\t2", None), ("bed", "chr1\t1\t2\n", "value"), ("bed", " ", "columns"),
        ("narrowpeak", "c\t1\t2", None), ("narrowpeak", "c\t1\t2\tn", "columns"), ("narrowpeak", "c\t1\t2\tn\t0\t.\t1\t-1e5\t1\t1", None),
        ("narrowpeak", "c\t1\t2\tn\t0\t.\t1\t1.\t1\t1", "value"), ("narrowpeak", "c\t1\t2\tn\t0\t.\t1\tnan\t1\t1", "value"),
        ("gaf", gaf, None), ("gaf", gaf.replace("GO:", "go:"), "value"), ("gaf", gaf + "\tz", "columns"),
        ("bed", "# c", "skip"), ("bed", "!x", "skip"), ("bed", "track name=1", "skip"), ("bed", "browser\thide", "skip"), ("bed", "\r", "skip"), ("bed", None, "skip"), ("bed", "tracker\t1\t2", None), ("bed", "track", "columns"),
        ("other", "a", None),
    ]
    df = spark.createDataFrame([(i, f, x, "clash") for i, (f, x, _) in enumerate(rows)], "line_id bigint, fmt string, line string, fields string")
    got = {r.line_id: r.reason for r in reject.parse_lines(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows) if w != "skip"}


def test_long_line_empty_table_and_typed_rows(spark):
    long = 'c\t1\t2\t"' + 'x""\t' * 100_000 + '"'
    df = spark.createDataFrame([(1, "bed", long)], "line_id bigint, fmt string, line string")
    r = reject.load_intervals(reject.parse_lines(df)).collect()[0]
    assert len(r.name) == 300_000 and r.chrom_start == 1
    assert reject.parse_lines(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    p = tmp_path / "a.bed"
    p.write_bytes(b"chr1\t1\t2\r\n#c\nchr1\tx\t2")
    x = reject.load_files(spark, str(p), "bed")
    assert sorted(r.reason or "" for r in x.collect()) == ["", "value"]
    assert x.where(F.col("file_name").endswith("a.bed")).count() == 2


def test_gaf_lines_are_typed_rows(spark):
    f = ["D", "Q1", "sym", "", "GO:0001234", "r1|r2", "IEA", "", "P", '"na\tme"', "s1||s2", "protein", "taxon:1", "20200101", "by", "", ""]
    rows = [(1, "gaf", "\t".join(f)), (2, "gaf", "\t".join(f[:16])), (3, "bed", "c\t1\t2"), (4, "gaf", "\t".join(f) + "\r"), (5, "gaf", "!c")]
    p = reject.parse_lines(spark.createDataFrame(rows, "line_id bigint, fmt string, line string"))
    got = {r.line_id: r for r in reject.load_annotations(p).collect()}
    assert set(got) == {1, 4}
    r = got[1]
    assert (r.db_id, r.go_id, r.go_number, r.name, r.gene_product_id) == ("Q1", "GO:0001234", 1234, "na\tme", None)
    assert (r.db_ref, r.synonym, r.qualifier, r.taxon) == (["r1", "r2"], ["s1", "s2"], [], ["taxon:1"])
    assert got[4].gene_product_id is None


def test_every_record_is_loaded_or_set_aside(spark):
    import os

    import pytest

    from helixframe.plans import problems

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    count = lambda x: {r.fmt: r["count"] for r in x.groupBy("fmt").count().collect()}
    lines = spark.read.parquet(f"{d}/raw_lines.parquet")
    records, aside = count(reject.parse_lines(lines)), count(problems.p1_found(spark, d).join(lines, "line_id"))
    loaded = count(problems.p1_loaded(spark, d).select("fmt").union(problems.p1_loaded_gaf(spark, d).select("fmt")))
    assert set(records) == {"bed", "narrowpeak", "gaf"}
    assert records == {k: loaded.get(k, 0) + aside.get(k, 0) for k in records}


def test_every_reason_has_its_offset(spark):
    gaf = ["x"] * 4 + ["go:1"] + ["y"] * 12
    np_ = ["c", "1", "2", '"n\té"', "0", ".", "1", "bad", "1", "1"]
    rows = [
        ("bed", "chr1\t1", 6), ("bed", "é\tx\t2\r", 3), ("bed", "c\t1\tx", 4), ("bed", "c\t5\t2", 4), ("bed", 'c\t1\t2\t"a"b', 9), ("bed", "c\t1\t2", None),
        ("gaf", "\t".join(gaf), 8), ("gaf", "a\tb\r", 3), ("narrowpeak", "\t".join(np_), len("\t".join(np_[:7]).encode()) + 1),
    ]
    df = spark.createDataFrame([(i, f, x) for i, (f, x, _) in enumerate(rows)], "line_id bigint, fmt string, line string")
    assert {r.line_id: r.error_offset for r in reject.parse_lines(df).collect()} == {i: w for i, (_, _, w) in enumerate(rows)}
