import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import reads as rd
from helixframe.sources import codecs, files, formats as fm, genome as gn, rest
from helixframe.streaming import beds


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line_no bigint")


def test_codecs(spark):
    dec = lambda fmt, *r: [tuple(x) for x in codecs.decode(lines(spark, *r), fmt).collect()]
    assert dec("bed", "c\t1\t2", "c\t1\t2\t.\t.\t.", "c\t1x\t2\tn\t5\t-\textra", "c\t1\t2\tn") == [("c", 1, 2, None, None, None), ("c", 1, 2, None, None, None), ("c", 1, 2, "n", 5, False), ("c", 1, 2, "n", None, None)]
    assert dec("bedgraph", "c\t1\t2\t1.5e1") == [("c", 1, 2, 15.0)]
    assert dec("narrowpeak", "c\t1\t2", "c\t1\t2\tn\t7\t*\t1.5\t-1\t2\t-1") == [("c", 1, 2, None, 0, None, 0.0, None, None, None), ("c", 1, 2, "n", 7, False, 1.5, None, 2.0, None)]
    assert dec("broadpeak", "c\t1\t2\t.\t7\t.\t1.5\t3\t-1") == [("c", 1, 2, None, 7, None, 1.5, 3.0, None)]
    assert dec("bedext", "c\t1\t2\t{\"a\":1}") == [("c", 1, 2, '{"a":1}')]
    for fmt, bad in (("bed", "c\t1"), ("bed", "c\tx\t2"), ("bed", "c\t1\t2\tn\t-4"), ("narrowpeak", "c\t1\t2\tn"), ("broadpeak", "c\t1\t2")):
        with pytest.raises(Exception, match="line|integer|negative"):
            dec(fmt, bad)
    with pytest.raises(ValueError):
        dec("vcf", "c")
    for fmt, row in (("bed", "c\t1\t2\tn\t5\t-"), ("narrowpeak", "c\t1\t2\tn\t7\t+\t1.5\t-1\t2.0\t-1"), ("broadpeak", "c\t1\t2\t.\t7\t.\t1.5\t3.0\t-1"), ("bedgraph", "c\t1\t2\t15.0"), ("bed3", "c\t1\t2")):
        assert codecs.encode(codecs.decode(lines(spark, row), fmt), fmt).collect()[0][0] == row


def test_bed_files(spark, tmp_path, capsys):
    p = tmp_path / "a.bed.gz"
    p.write_bytes(gzip.compress(b"chr1\t1\t2\n") + gzip.compress(b"chr1\t3\t4\n"))
    df = codecs.read_bed(spark, str(p), "bed3")
    assert sorted(map(tuple, df.collect())) == [("chr1", 1, 2), ("chr1", 3, 4)]
    codecs.write_bed(df, str(tmp_path / "out"), "bed3", gzip=True)
    assert codecs.read_bed(spark, str(tmp_path / "out"), "bed3").count() == 2
    codecs.print_bed(df.orderBy("chrom_start"), "bed3")
    assert capsys.readouterr().out == "chr1\t1\t2\nchr1\t3\t4\n"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bed").write_text("a\t1\t5\na\t2\t3\nb\t0\t9\n")
    got = beds.run_once(beds.counts_by_chrom(beds.stream_bed(spark, str(tmp_path / "in"), "bed3")), "bed_counts", "complete")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 5), ("b", 1, 9)]
    (tmp_path / "in/b.bed").write_text("a\t1\n")
    r = beds.run_once(beds.stream_rejects(spark, str(tmp_path / "in"), "bed"), "bed_rejects")
    assert sorted(x.reason or "" for x in r.collect()) == ["", "", "", "columns"]
    ev = spark.createDataFrame([("2020-01-01 00:00:01", "x"), ("2020-01-01 00:07:00", "x")], "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    ev.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    w = beds.run_once(beds.counts_by_window(s, "t", "5 minutes", "1 minute", "k"), "win", "complete")
    assert sorted(x.n for x in w.collect()) == [1, 1]


def test_fasta_fastq(spark, tmp_path):
    files.register(spark)
    (tmp_path / "g.fa").write_text(">chr1 first\nACGTN\n\nacgt\n>chr2\nGG\n>chr3")
    fa = spark.read.format("fasta").load(str(tmp_path / "g.fa"))
    assert [tuple(r) for r in fa.collect()] == [("chr1 first", ["ACGTN", "acgt"]), ("chr2", ["GG"]), ("chr3", [])]
    with pytest.raises(ValueError):
        list(files.fasta_records(iter(["ACGT", ">x"])))
    plain = "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+r2\nII"
    wrapped = "@r1 x\r\nAC\r\nGT\r\n+\r\n@I\r\nII\r\n\r\n@r2\r\nAC\r\n+r2\r\nII\r\n"
    (tmp_path / "a.fastq").write_text(plain)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(wrapped[:20].encode()) + gzip.compress(wrapped[20:].encode()))
    want = [("r1 x", "ACGT", "@III"), ("r2", "AC", "II")]
    for f in ("a.fastq", "b.fastq.gz"):
        assert [tuple(r) for r in spark.read.format("fastq").load(str(tmp_path / f)).collect()] == want
    assert spark.read.format("fastq").load(str(tmp_path / "*.fastq*")).count() == 4
    for bad in (["ACGT"], ["@r", "ACGT"], ["@r", "ACGT", "+", "II"], ["@r", "A", "+", "IIII"]):
        with pytest.raises(ValueError):
            list(files.fastq_records(iter(bad)))
    r = spark.createDataFrame([("a", "CGAAAA", "IIIIII"), ("b", "CGA", "III")], "seq_id string, seq string, qual string")
    assert rd.fastq_lines(rd.trim_poly_a(r, 3)).collect()[0][0] == "@a\nCG\n+\nII"
    rd.write_fastq(r, str(tmp_path / "o"), gzip=True)
    assert spark.read.format("fastq").load(str(tmp_path / "o")).count() == 2


def test_bam(spark, tmp_path):
    rng = random.Random(1)
    refs = [("chr1", 10_000), ("chr2", 5000)]
    recs = []
    for i in range(700):
        q = f"q{i // 2}"
        first = i % 2 == 0
        s = "".join(rng.choice("ACGTN") for _ in range(50))
        flag = 1 | (64 if first else 128) | (16 if rng.random() < 0.5 else 0)
        recs.append((i, q, flag, "chr1", 100 + i, 30, "10S30M5D10M", "chr1", 90 + i, 0, s, "I" * 50, {"MC": "5S20M2N25M", "RG": "x"}))
    recs.append((700, "u", 4, None, -1, 0, None, None, -1, 0, None, None, {}))
    p = str(tmp_path / "a.bam")
    header = "@HD\tVN:1.6\tSO:queryname\n"
    files.write_bam(p, header, refs, iter(recs))
    assert files.bam_header(p) == (header, refs)
    assert [(*r[:-1], dict(r[-1])) for r in files.bam_records(p)] == recs
    files.register(spark)
    bam = spark.read.format("bam").load(p)
    assert bam.count() == 701
    bed = rd.bam_to_bed(bam).where("name = 'q0'").orderBy("chrom_start").collect()
    assert tuple(bed[0])[:5] == ("chr1", 100, 145, "q0", 30) and bed[0].strand == (recs[0][2] & 16 == 0)
    frag = rd.bam_to_fragment(bam)
    assert frag.count() == 350 and tuple(frag.orderBy("chrom_start").collect()[0]) == ("chr1", 90, 145)
    pe = rd.sorted_bam_to_bedpe(bam, header)
    r = pe.where("name = 'q3'").collect()
    assert pe.count() == 350 and (r[0].start1, r[0].start2, r[0].end1) == (106, 107, 151)
    with pytest.raises(ValueError):
        rd.sorted_bam_to_bedpe(bam, "@HD\tSO:coordinate")
    assert rd.bam_to_fastq(bam).count() == 700
    with pytest.raises(Exception, match="no MC tag"):
        rd.bam_to_fragment(bam.withColumn("tags", F.create_map().cast("map<string,string>"))).collect()


def test_genome(spark, tmp_path):
    rng = random.Random(2)
    seq = {"c1": "".join(rng.choice("ACGTN") for _ in range(1000)), "c2": "ACGT"}
    (tmp_path / "g.fa").write_text("".join(f">{k} desc\n" + "\n".join(v[i : i + 60] for i in range(0, len(v), 60)) + "\n" for k, v in seq.items()))
    gn.make_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "idx"), 64)
    g = gn.open_genome(spark, str(tmp_path / "idx"))
    assert {r.chrom: r.size for r in gn.chrom_sizes(g).collect()} == {"c1": 1000, "c2": 4}
    assert "".join(r.seq for r in gn.chrom_seq(g, "c1").collect()) == seq["c1"]
    rows = [(0, "c1", 0, 1000, True), (1, "c1", 63, 65, False), (2, "c2", 1, 4, None), (3, "c2", -1, 2, None), (4, "c2", 0, 5, None), (5, "zz", 0, 1, None), (6, "c1", 5, 5, None)]
    df = spark.createDataFrame(rows, "region_id int, chrom string, chrom_start bigint, chrom_end bigint, strand boolean")
    r = {x.region_id: x for x in gn.get_seq(df, g, chunk=64, stranded=True).collect()}
    comp = str.maketrans("ACGT", "TGCA")
    assert r[0].seq == seq["c1"] and r[1].seq == seq["c1"][63:65][::-1].translate(comp) and r[2].seq == "CGT"
    assert [r[i].seq_error for i in range(7)] == [None, None, None, "negative start", "end beyond chromosome", "unknown chromosome", "empty region"]


def test_gaf_owl_tab2_json(spark, tmp_path):
    gaf = "\t".join(["DB", "id1", "Sym", "", "GO:0000012", "PMID:1|PMID:2", "IEA", "", "F", "nm", "s1|s2", "protein", "taxon:9", "20200101", "X", "", ""])
    r = fm.gaf_records(lines(spark, "!gaf-version: 2.1", "", gaf, "! later comment")).collect()
    assert len(r) == 1 and r[0].go_number == 12 and r[0].db_ref == ["PMID:1", "PMID:2"] and r[0].qualifier == [] and r[0].annotation_extension == []
    with pytest.raises(Exception, match="17"):
        fm.gaf_records(lines(spark, "a\tb")).collect()
    owl = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b">
<owl:Class rdf:about="http://x/GO_0000001"><rdfs:label>one</rdfs:label><oboInOwl:id>GO:0000001</oboInOwl:id><oboInOwl:hasOBONamespace>bp</oboInOwl:hasOBONamespace></owl:Class>
<owl:Class rdf:about="http://x/GO_0000002"><rdfs:label>two</rdfs:label><rdfs:subClassOf rdf:resource="http://x/GO_0000001"/><rdfs:subClassOf rdf:resource="http://x/GO_0000003"/></owl:Class>
<owl:Class rdf:about="http://x/GO_0000004"><owl:deprecated rdf:datatype="b">true</owl:deprecated><rdfs:label>old</rdfs:label></owl:Class>
</rdf:RDF>"""
    (tmp_path / "go.owl").write_text(owl)
    t = fm.read_owl(spark, str(tmp_path / "go.owl"))
    assert sorted((x.id, x.label, x.namespace, tuple(x.parents)) for x in t.collect()) == [(1, "one", "bp", ()), (2, "two", None, (1, 3))]
    assert fm.owl_map(t).count() == 2
    with pytest.raises(Exception, match="duplicate term"):
        fm.owl_map(t.union(t)).collect()
    tab = "\t".join(["1", *["x"] * 8, "a|b", "-", *["y"] * 7, "-", *["z"] * 5])
    x = fm.tab2_records(lines(spark, "#h", tab)).collect()[0]
    assert x.synonyms_a == ["a", "b"] and x.synonyms_b == [] and x.score is None and x.interaction_id == "1"
    ids, mp = spark.createDataFrame([("a",), ("q",), ("a",)], "id string"), spark.createDataFrame([("a", "2"), ("a", "1")], "source string, target string")
    assert sorted(map(tuple, fm.map_ids(ids, mp).collect()), key=repr) == [("a", "1"), ("a", "1"), ("q", None)]
    js = spark.createDataFrame([('{"a": [{"b": 7}]}',)], "j string")
    assert js.select(fm.json_path(F.col("j"), "$.a[0].b", "int")).collect()[0][0] == 7
    with pytest.raises(Exception, match="no \\$.z"):
        js.select(fm.json_path(F.col("j"), "$.z")).collect()
    assert "\n" in js.select(fm.pretty_json(F.col("j"))).collect()[0][0]
    m = spark.createDataFrame([(json.dumps({"celltype": "k", "files": [{"location": "p"}]}),), ("{}",)], "json string")
    assert [(r.celltype, len(r.eid), len(r.files)) for r in fm.manifest_files(m).collect()] == [("k", 32, 1), ("", 32, 0)]


def test_rest(spark):
    q = rest.terms("b", "a", "b") + rest.cell_is("K562") + rest.assay_is("ChIP-seq") + rest.cell_is("K562")
    assert q.url("https://x.org/") == "https://x.org/search/?searchTerm=a+b&assay_term_name=ChIP-seq&biosample_term_name=K562&type=experiment&frame=object&limit=all"
    assert [len(json.loads(b)["ids"]) for b in rest.lookup_bodies([str(i) for i in range(2500)])] == [1000, 1000, 500]
    assert rest.merge_lookups([{"a": 1}, {"a": 2, "b": 3}]) == {"a": 1, "b": 3}
    assert rest.aligned(["x", "y"], rest.parse_id_table("From\tTo\nx\t1\nx\t2\n")) == ["1", None]
    assert rest.top_pathways('[{"dbId": 1, "extra": 2}]') == [{"dbId": 1, "stId": None, "displayName": None, "hasDiagram": None, "speciesName": None, "releaseDate": None}]
    assert rest.open_experiment_url("http://h", "", "/experiments/E1/") == "http://h/experiments/E1/?format=json"


def test_rest_source_reads_local_urls(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"n": i}))
    df = rest.fetch(spark, [f"file://{tmp_path}/{i}.json" for i in range(3)])
    assert sorted(r[0] for r in df.select(F.variant_get("value", "$.n", "int")).collect()) == [0, 1, 2]


def test_listing_and_truncated_gzip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.fq", "a.fq", "_x.fq", ".y.fq"):
        (tmp_path / "d" / n).write_text("@r\nAC\n+\nII\n")
    want = [f"{tmp_path}/d/a.fq", f"{tmp_path}/d/b.fq"]
    assert files.list_files(f"{tmp_path}/d") == want and files.list_files(f"{tmp_path}/*/[ab].fq") == want
    assert files.list_files(f"file://{tmp_path}/d/*.fq") == ["file://" + w for w in want]
    with pytest.raises(FileNotFoundError):
        files.list_files(f"{tmp_path}/none")
    data = gzip.compress(b"".join(b"line %d\n" % i for i in range(50_000)))
    (tmp_path / "whole.gz").write_bytes(data + data)
    assert sum(1 for _ in files.lines(str(tmp_path / "whole.gz"))) == 100_000
    for cut in (len(data) // 2, len(data) + 40):
        (tmp_path / "cut.gz").write_bytes((data + data)[:cut])
        with pytest.raises(ValueError, match="truncated"):
            sum(1 for _ in files.lines(str(tmp_path / "cut.gz")))


def test_bam_files_of_all_partitions(spark, tmp_path):
    df = spark.range(900).selectExpr("id rec_no", "concat('q', id div 2) qname", "cast(64 * (1 + id % 2) + 1 as int) flag", "'c' ref", "id pos", "cast(9 as int) mapq", "'5M' cigar", "'c' mate_ref", "id mate_pos", "cast(0 as int) tlen", "'ACGTA' seq", "'IIIII' qual", "cast(map('MC', '5M') as map<string,string>) tags").repartitionByRange(3, "rec_no").sortWithinPartitions("rec_no")
    paths = files.write_bam_files(df, f"file://{tmp_path}/out", "@HD\tSO:queryname\n", [("c", 1000)])
    assert len(paths) == 3
    files.register(spark)
    got = spark.read.format("bam").load(f"{tmp_path}/out")
    assert got.count() == 900 and got.select("rec_no").distinct().count() == 900
    assert rd.sorted_bam_to_bedpe(got, "SO:queryname").count() == 450
