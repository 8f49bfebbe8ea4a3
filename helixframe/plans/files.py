"""Queries that write files of every format from the tables and read them back; the SQL gives what must come out."""

from __future__ import annotations

import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import sequence as sq
from helixframe.operators import annotation as an, reads as rd
from helixframe.plans import derive as dv
from helixframe.plans.derive import MOTIFS, SQL
from helixframe.plans.genomics import query as _register
from helixframe.runtime import read_table, shared_folder
from helixframe.sources import codecs, files, formats, genome as gn, rest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    return _register(sql, *parts, queries=QUERIES, oracle=ORACLE)


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _texts(df: DataFrame, path: str, **options) -> str:
    df.write.text(path, **options)
    return path


# --- BED family ----------------------------------------------------------------------------------
_BED = "SELECT chrom, chrom_start, chrom_end, CASE WHEN bed_name <> '.' THEN bed_name END AS name, bed_score AS score, bed_strand AS strand FROM bed"


@query(_BED)
def s1_bed_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bed")
    codecs.write_bed(dv.tags(spark, d), path, "bed")
    return codecs.read_bed(spark, path, "bed")


@query(_BED)
def s2_bed_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "bedgz")
    codecs.write_bed(dv.tags(spark, d), path, "bed", gzip=True)
    return codecs.read_bed(spark, path, "bed")


@query("SELECT 'track' AS chrom, track_id AS chrom_start, track_id + 10 AS chrom_end FROM tracks")
def s6_print_bed(spark: SparkSession, d: str) -> DataFrame:
    """The file list, printed line by line and parsed again."""
    out = io.StringIO()
    codecs.print_bed(read_table(spark, d, "tracks").select(F.lit("track").alias("chrom"), F.col("track_id").alias("chrom_start"), (F.col("track_id") + 10).alias("chrom_end")), "bed3", out)
    return codecs.decode(spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "value string"), "bed3")


@query("SELECT chrom, chrom_start, chrom_end FROM bed")
def s10_bed3_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codecs.decode(codecs.encode(dv.tags(spark, d), "bed3"), "bed3")


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "narrowpeak")
    names = {"chrom": "np_chrom", "chrom_start": "np_start", "chrom_end": "np_end", "name": "np_name", "score": "np_score", "strand": "np_strand", "pvalue": "np_pvalue", "qvalue": "np_qvalue", "peak": "np_peak"}
    return p.select(*[F.col(c).alias(n) for n, c in names.items()], F.coalesce(F.nanvl("np_signal", F.lit(0.0)), F.lit(0.0)).alias("signal"))


_PEAK = """SELECT np_chrom AS chrom, np_start AS chrom_start, np_end AS chrom_end, CASE WHEN np_name <> '.' THEN np_name END AS name, coalesce(np_score, 0) AS score, np_strand AS strand,
  CASE WHEN isnan(np_signal) THEN 0 ELSE coalesce(np_signal, 0) END AS signal, CASE WHEN np_pvalue >= 0 THEN np_pvalue END AS pvalue, CASE WHEN np_qvalue >= 0 THEN np_qvalue END AS qvalue{} FROM narrowpeak"""


@query(_PEAK.format(", CASE WHEN np_peak >= 0 THEN np_peak END AS peak"))
def s12_narrowpeak_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "narrowpeak")
    codecs.write_bed(_peaks(spark, d), path, "narrowpeak", gzip=True)
    return codecs.read_bed(spark, path, "narrowpeak")


@query(_PEAK.format(""))
def s13_broadpeak_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "broadpeak")
    codecs.write_bed(_peaks(spark, d), path, "broadpeak")
    return codecs.read_bed(spark, path, "broadpeak")


@query("SELECT chrom, chrom_start, chrom_end, rec_id, bed_name AS label FROM bed")
def s14_bedext_file(spark: SparkSession, d: str) -> DataFrame:
    """Records with a JSON payload."""
    path = _folder(spark, "bedext")
    codecs.write_bed(dv.tags(spark, d).withColumn("payload", F.to_json(F.struct("rec_id", "name"))), path, "bedext")
    x = codecs.read_bed(spark, path, "bedext").withColumn("p", F.from_json("payload", "rec_id bigint, name string"))
    return x.select("chrom", "chrom_start", "chrom_end", F.col("p.rec_id").alias("rec_id"), F.col("p.name").alias("label"))


@query("SELECT peak_id, -np_start AS a, np_end AS b, np_pvalue AS x FROM narrowpeak")
def s15_number_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Signed numbers followed by other letters."""
    p = read_table(spark, d, "narrowpeak")
    text = lambda *c: F.concat(*c)
    return p.select("peak_id", codecs.read_int(text(F.lit("-"), "np_start", F.lit("kb 7"))).alias("a"), codecs.read_int(text(F.lit("+"), "np_end", F.lit(".5"))).alias("b"), codecs.read_double(text(F.col("np_pvalue").cast("string"), F.lit("x1"))).alias("x"))


# --- FASTA, FASTQ --------------------------------------------------------------------------------
def _fasta(spark: SparkSession, d: str) -> str:
    """Sequences as wrapped FASTA with blank lines between the records."""
    body = F.regexp_replace("seq", "(.{60})", "$1\n")
    return _texts(dv.sequences(spark, d).select(F.concat(F.lit(">"), "doc_id", F.lit(" text\n"), body, F.lit("\n"))), _folder(spark, "fasta"))


@query("SELECT doc_id::VARCHAR || ' text' AS header, (length(seq) + 59) // 60 AS n_lines, md5(seq) AS seq_md5 FROM seqs", "seqs")
def s16_fasta_file(spark: SparkSession, d: str) -> DataFrame:
    files.register(spark)
    x = spark.read.format("fasta").load(_fasta(spark, d))
    return x.select("header", F.size("body").cast("bigint").alias("n_lines"), F.md5(sq.validated(F.array_join("body", ""))).alias("seq_md5"))


_READS = "SELECT doc_id::VARCHAR AS seq_id, length(qual) AS n, md5(substr(repeat('ACGT', (length(qual) // 4 + 1)::INTEGER), 1, length(qual))) AS seq_md5, md5(qual) AS qual_md5 FROM reads"


def _reads(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("qual")
    return dv.reads(spark, d).select(F.col("doc_id").cast("string").alias("seq_id"), F.substring(F.repeat(F.lit("ACGT"), (n / 4).cast("int") + 1), F.lit(1), n).alias("seq"), "qual")


def _read_fastq(spark: SparkSession, path: str) -> DataFrame:
    files.register(spark)
    return spark.read.format("fastq").load(path).select("seq_id", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


@query(_READS, "reads")
def s19_fastq_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "fastq")
    rd.write_fastq(_reads(spark, d), path)
    return _read_fastq(spark, path)


@query(_READS, "reads")
def s20_fastq_wrapped_gzip(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped lines, gzip; quality lines may begin with any mark."""
    wrap = lambda c: F.regexp_replace(c, "(.{70})", "$1\n")
    x = _reads(spark, d).select(F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), wrap("seq"), F.lit("+"), wrap("qual")))
    return _read_fastq(spark, _texts(x, _folder(spark, "wrapped"), compression="gzip"))


# --- BAM -----------------------------------------------------------------------------------------
def _bam(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Two mates an order, by name; every seventh first mate is unmapped."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("chr"), F.col("o_custkey") % 25).alias("chr"), (F.col("o_orderkey") % 5000 * 100).alias("p"), (F.col("o_custkey") % 3 == 0).alias("rev"))
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    x = o.select("*", side.alias("m"))
    off = (F.col("m") == 0) & (F.col("k") % 7 == 0)
    flag = F.lit(1) + F.when(off, 4).otherwise(0) + F.when((F.col("m") == 1) & (F.col("k") % 7 == 0), 8).otherwise(0) + F.when(F.col("rev"), 16).otherwise(0) + F.when(F.col("m") == 0, 64).otherwise(128)
    seq = F.when(F.col("k") % 11 != 0, F.substring(F.repeat(F.lit("ACGTN"), 11), F.lit(1), F.lit(50)))
    y = x.select((F.col("k") * 2 + F.col("m")).alias("rec_no"), F.concat(F.lit("q"), "k").alias("qname"), flag.cast("int").alias("flag"), F.when(~off, F.col("chr")).alias("ref"), F.when(off, -1).otherwise(F.col("p") + F.col("m") * 30).alias("pos"),
        (F.col("k") % 60).cast("int").alias("mapq"), F.when(~off, F.when(F.col("m") == 0, "5S40M2D5M").otherwise("20M3N30M")).alias("cigar"), F.col("chr").alias("mate_ref"), (F.col("p") + (1 - F.col("m")) * 30).alias("mate_pos"), F.lit(0).alias("tlen"),
        seq.alias("seq"), F.when(seq.isNotNull(), F.repeat(F.lit("I"), 50)).alias("qual"), F.create_map(F.lit("MC"), F.when(F.col("m") == 0, "20M3N30M").otherwise("5S40M2D5M")).alias("tags"))
    header = "@HD\tVN:1.6\tSO:queryname\n"
    path = _folder(spark, "bam")
    files.write_bam_files(y.repartitionByRange(F.floor(F.col("rec_no") / 2)).sortWithinPartitions("rec_no"), path, header, [(f"chr{i}", 1_000_000) for i in range(25)])
    files.register(spark)
    return spark.read.format("bam").load(path), files.bam_header(files.list_files(path)[0])[0]


# A first mate covers 47 bases of the reference (40M2D5M), a second one 53 (20M3N30M).
SQL["mates"] = """mates AS (SELECT o_orderkey AS k, 'chr' || (o_custkey % 25) AS chr, o_orderkey % 5000 * 100 AS p, o_custkey % 3 = 0 AS rev, m, m = 0 AND o_orderkey % 7 = 0 AS off FROM orders, (SELECT unnest([0, 1]) AS m))"""


@query("""SELECT 'q' || k AS qname, (1 + CASE WHEN off THEN 4 ELSE 0 END + CASE WHEN m = 1 AND k % 7 = 0 THEN 8 ELSE 0 END + CASE WHEN rev THEN 16 ELSE 0 END + CASE WHEN m = 0 THEN 64 ELSE 128 END)::INTEGER AS flag,
  CASE WHEN NOT off THEN chr END AS ref, CASE WHEN off THEN -1 ELSE p + m * 30 END AS pos, (k % 60)::INTEGER AS mapq, CASE WHEN NOT off THEN CASE WHEN m = 0 THEN '5S40M2D5M' ELSE '20M3N30M' END END AS cigar, chr AS mate_ref, p + (1 - m) * 30 AS mate_pos,
  CASE WHEN k % 11 <> 0 THEN repeat('ACGTN', 10) END AS seq, CASE WHEN k % 11 <> 0 THEN repeat('I', 50) END AS qual, CASE WHEN m = 0 THEN '20M3N30M' ELSE '5S40M2D5M' END AS mc FROM mates""", "mates")
def s23_bam_file(spark: SparkSession, d: str) -> DataFrame:
    x = _bam(spark, d)[0]
    return x.select("qname", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "seq", "qual", F.try_element_at("tags", F.lit("MC")).alias("mc"))


@query("SELECT chr AS chrom, p + m * 30 AS chrom_start, p + m * 30 + CASE WHEN m = 0 THEN 47 ELSE 53 END AS chrom_end, 'q' || k AS name, (k % 60)::INTEGER AS score, NOT rev AS strand FROM mates WHERE NOT off", "mates")
def b1_bam_to_bed(spark: SparkSession, d: str) -> DataFrame:
    return rd.bam_to_bed(_bam(spark, d)[0])


@query("SELECT chr AS chrom, p AS chrom_start, p + 83 AS chrom_end FROM mates WHERE m = 0 AND NOT off", "mates")
def b2_bam_to_fragment(spark: SparkSession, d: str) -> DataFrame:
    return rd.bam_to_fragment(_bam(spark, d)[0])


@query("""SELECT 'q' || k AS name, chr AS chrom1, p AS start1, p + 47 AS end1, (k % 60)::INTEGER AS score1, NOT rev AS strand1, chr AS chrom2, p + 30 AS start2, p + 83 AS end2, (k % 60)::INTEGER AS score2, NOT rev AS strand2
  FROM mates WHERE m = 0 AND NOT off""", "mates")
def b3_bam_to_bedpe(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours pair up; an unmapped mate takes the pair out. Pairs that fall on both sides of a file's border would not meet, so files hold whole pairs."""
    bam, header = _bam(spark, d)
    return rd.sorted_bam_to_bedpe(bam, header)


@query("SELECT 'q' || k AS seq_id, repeat('ACGTN', 10) AS seq, repeat('I', 50) AS qual FROM mates WHERE k % 11 <> 0", "mates")
def b4_bam_to_fastq(spark: SparkSession, d: str) -> DataFrame:
    return rd.bam_to_fastq(_bam(spark, d)[0])


# --- genome --------------------------------------------------------------------------------------
SQL["genome"] = """genome AS (SELECT 'chr' || (doc_id % 10) AS chrom, string_agg(seq, '' ORDER BY doc_id) AS s FROM seqs GROUP BY ALL),
 regions AS (SELECT peak_id AS region_id, 'chr' || (peak_id % 12) AS chrom, np_start % 50000 - 100 AS s0, np_start % 50000 - 100 + peak_id % 300 AS e0, np_strand AS strand FROM narrowpeak),
 got AS (SELECT r.*, CASE WHEN g.chrom IS NULL THEN 'unknown chromosome' WHEN s0 < 0 THEN 'negative start' WHEN e0 > length(s) THEN 'end beyond chromosome' WHEN e0 <= s0 THEN 'empty region' END AS err, s FROM regions r LEFT JOIN genome g USING (chrom))"""


def _genome(spark: SparkSession, d: str) -> DataFrame:
    """Ten chroms, written as FASTA and indexed."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "seq"))), lambda v: v["seq"])
    g = dv.sequences(spark, d).where("seq != ''").groupBy((F.col("doc_id") % 10).alias("c")).agg(F.array_join(rows, "\n").alias("body"))
    fasta = _texts(g.select(F.concat(F.lit(">chr"), "c", F.lit(" made\n"), "body")), _folder(spark, "genome"))
    out = _folder(spark, "index")
    gn.make_index(spark, fasta, out, 1 << 10)
    return gn.open_genome(spark, out)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("np_start") % 50000 - 100
    return read_table(spark, d, "narrowpeak").select(F.col("peak_id").alias("region_id"), F.concat(F.lit("chr"), F.col("peak_id") % 12).alias("chrom"), s.alias("chrom_start"), (s + F.col("peak_id") % 300).alias("chrom_end"), F.col("np_strand").alias("strand"))


@query("SELECT chrom, length(s) AS size FROM genome", "seqs", "genome")
def s26_chrom_sizes(spark: SparkSession, d: str) -> DataFrame:
    return gn.chrom_sizes(_genome(spark, d))


@query("SELECT length(s) AS size, md5(s) AS seq_md5 FROM genome WHERE chrom = 'chr3'", "seqs", "genome")
def s26_chrom_seq(spark: SparkSession, d: str) -> DataFrame:
    """One chrom put together again from its chunks."""
    x = gn.chrom_seq(_genome(spark, d), "chr3").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "seq"))), lambda v: v["seq"]), "").alias("s"))
    return x.select(F.length("s").cast("bigint").alias("size"), F.md5("s").alias("seq_md5"))


@query("SELECT region_id, CASE WHEN err IS NULL THEN substr(s, s0 + 1, e0 - s0) END AS seq, err AS seq_error FROM got", "seqs", "genome")
def s24_genome_file(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of regions from a written index, or why there is none."""
    return gn.get_seq(_regions(spark, d), _genome(spark, d), chunk=1 << 10).select("region_id", "seq", "seq_error")


@query("SELECT region_id, CASE WHEN err IS NULL THEN CASE WHEN strand = false THEN reverse(translate(substr(s, s0 + 1, e0 - s0), 'ACGT', 'TGCA')) ELSE substr(s, s0 + 1, e0 - s0) END END AS seq FROM got", "seqs", "genome")
def j9_stranded_seq(spark: SparkSession, d: str) -> DataFrame:
    return gn.get_seq(_regions(spark, d), _genome(spark, d), chunk=1 << 10, stranded=True).select("region_id", "seq")


# --- motif files ---------------------------------------------------------------------------------
#: The motifs of the queries by rule: name, favoured letters, probability of those; the other three letters share the rest.
FAVOURED = [("tata", "TATAAT", 0.85), ("ebox", "CACGTGAC", 0.7)]
SQL["mots"] = "mots AS (SELECT name, word, top, unnest(range(length(word))) AS j FROM (VALUES " + ", ".join(f"('{n}', '{w}', {t}::DOUBLE)" for n, w, t in FAVOURED) + ") v(name, word, top))"
_ROWS = "SELECT name, j, round(CASE WHEN word[j + 1] = b THEN top ELSE (1 - top) / 3 END, 9) AS p, b AS base{} FROM mots, (SELECT unnest(['A', 'C', 'G', 'T']) AS b)"


def _long(m: DataFrame, *more: str) -> DataFrame:
    x = m.select("name", *more, F.posexplode("mat").alias("j", "row")).select("name", *more, F.col("j").cast("bigint").alias("j"), F.posexplode("row").alias("i", "p"))
    return x.select("name", *more, "j", F.element_at(F.array(*[F.lit(c) for c in "ACGT"]), F.col("i") + 1).alias("base"), F.round("p", 9).alias("p"))


@query(_ROWS.format(", CASE name WHEN 'tata' THEN 20 ELSE 11 END AS n_sites"), "mots")
def s28_meme_file(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(formats.to_meme(MOTIFS),)], "value string").coalesce(1)
    return _long(formats.read_meme(spark, _texts(x, _folder(spark, "meme"))), "n_sites")


@query(_ROWS.format(""), "mots")
def s30_motif_fasta(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(formats.to_motif_fasta(MOTIFS),)], "value string").coalesce(1)
    text = spark.read.text(_texts(x, _folder(spark, "motifs")), wholetext=True)
    return _long(formats.motif_table(spark, formats.parse_motif_fasta(text.first()[0])))


# --- GTF, ontology, annotation -------------------------------------------------------------------
def _gtf(spark: SparkSession, d: str) -> DataFrame:
    """The elements as GTF lines (1-based, inclusive), with comments and other features between."""
    e = dv.gene_elements(spark, d)
    attr = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f'{k} "'), c, F.lit('"; ')))
    ids = F.concat_ws("", attr("gene_id", F.col("gene_id")), attr("gene_name", F.col("gene_name")), attr("transcript_id", F.col("transcript_id")), F.when(F.col("feature") == "transcript", F.when(F.col("coding"), 'transcript_type "protein_coding";').otherwise('transcript_type "lncRNA";')))
    strand = F.when(F.col("strand"), "+").otherwise("-")
    line = lambda f: F.concat_ws("\t", F.coalesce("chrom", F.lit("chrN")), F.lit("made"), f, F.col("left") + 1, F.col("right_incl") + 1, F.lit("."), strand, F.lit("."), ids)
    every = F.array(line(F.when(F.col("feature") == "gene", "Gene").otherwise(F.col("feature"))), F.lit("# comment"), line(F.lit("CDS")))
    return formats.read_gtf(spark, _texts(e.select(F.explode(every)), _folder(spark, "gtf")))


SQL["elements"] = """elements AS (SELECT 'gene' AS feature, 'chr' || c_nationkey AS chrom, c_custkey * 2000 AS l, c_custkey * 2000 + 1500 AS r, c_acctbal >= 0 AS strand, c_custkey::VARCHAR AS gene_id, c_name AS gene_name, NULL::VARCHAR AS transcript_id, true AS coding FROM customer
 UNION ALL SELECT 'transcript', NULL, o_custkey * 2000 + o_orderkey % 700, o_custkey * 2000 + 800 + o_orderkey % 600, NULL, o_custkey::VARCHAR, NULL, o_orderkey::VARCHAR, o_orderstatus <> 'P' FROM orders
 UNION ALL SELECT 'exon', NULL, l_partkey, l_partkey + (l_quantity * 10)::BIGINT, NULL, NULL, NULL, l_orderkey::VARCHAR, true FROM lineitem)"""


@query("SELECT feature, coalesce(chrom, 'chrN') AS chrom, l AS \"left\", r AS right_incl, coalesce(strand, false) AS strand, gene_id, gene_name, transcript_id, coding FROM elements", "elements")
def s32_gtf_elements(spark: SparkSession, d: str) -> DataFrame:
    return _gtf(spark, d).drop("line_no")


@query("""SELECT g.gene_id, g.gene_name, g.chrom, g.l AS gene_left, g.r AS gene_right, g.strand, t.transcript_id, t.l AS transcript_left, t.r AS transcript_right, t.coding, x.l AS exon_left, x.r AS exon_right
  FROM (SELECT * FROM elements WHERE feature = 'gene') g LEFT JOIN (SELECT * FROM elements WHERE feature = 'transcript') t USING (gene_id)
  LEFT JOIN (SELECT DISTINCT transcript_id, l, r FROM elements WHERE feature = 'exon') x ON x.transcript_id = t.transcript_id""", "elements")
def s31_gene_models_file(spark: SparkSession, d: str) -> DataFrame:
    """Genes of GTF files with all transcripts and exons, one row each."""
    return gene_rows(an.gene_models(_gtf(spark, d)))


def gene_rows(g: DataFrame) -> DataFrame:
    """Nested gene models as rows."""
    x = g.select("gene_id", "gene_name", "chrom", F.col("left").alias("gene_left"), F.col("right_incl").alias("gene_right"), "strand", F.explode_outer("transcripts").alias("t"))
    x = x.select("*", F.explode_outer("t.exons").alias("x"))
    return x.select("gene_id", "gene_name", "chrom", "gene_left", "gene_right", "strand", F.col("t.transcript_id").alias("transcript_id"), F.col("t.left").alias("transcript_left"), F.col("t.right").alias("transcript_right"), F.col("t.coding").alias("coding"), F.col("x.left").alias("exon_left"), F.col("x.right").alias("exon_right"))


def _owl(spark: SparkSession, d: str) -> DataFrame:
    sub = read_table(spark, d, "go_subclass").where("sub_class_of IS NOT NULL").select(F.col("obo_id").alias("c"), F.regexp_extract("sub_class_of", "([0-9]+)$", 1).alias("p")).where("p != ''")
    up = sub.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://made/GO_'), "p", F.lit('"/>')))), "").alias("up"))
    g = read_table(spark, d, "go").join(up, F.col("obo_id") == F.col("c"), "left")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda k, c: F.concat(F.lit(f"<{k}>"), c, F.lit(f"</{k}>"))
    line = F.concat_ws("", F.lit('<owl:Class rdf:about="http://made/GO_'), "obo_id", F.lit('">'), tag("rdfs:label", esc(F.col("label"))), tag("oboInOwl:id", F.concat(F.lit("GO:"), F.lpad(F.col("obo_id").cast("string"), 7, "0"))), tag("oboInOwl:hasOBONamespace", F.col("obo_ns")),
        F.when(F.col("deprecated_at").isNotNull(), F.lit('<owl:deprecated rdf:datatype="x">true</owl:deprecated>')), "up", F.lit("<rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>"))
    head, foot = '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b">', "</rdf:RDF>"

    def document(batches):  # every part file is a document of its own
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([foot])], names=["value"])

    return formats.read_owl(spark, _texts(g.select(line.alias("value")).mapInArrow(document, "value string"), _folder(spark, "owl")))


@query("""SELECT obo_id AS id, trim(label) AS label, obo_ns AS namespace, coalesce(parents, '') AS parents FROM go LEFT JOIN (SELECT obo_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS parents FROM
  (SELECT obo_id, try_cast(regexp_extract(sub_class_of, '([0-9]+)$', 1) AS BIGINT) AS p FROM go_subclass) WHERE p IS NOT NULL GROUP BY obo_id) USING (obo_id) WHERE deprecated_at IS NULL""")
def s33_owl_file(spark: SparkSession, d: str) -> DataFrame:
    """Terms of ontology XML; outer spaces of labels are not kept by XML."""
    x = _owl(spark, d)
    return x.select("id", F.trim("label").alias("label"), "namespace", F.array_join(F.transform(F.sort_array("parents"), lambda v: v.cast("string")), ",").alias("parents"))


@query("SELECT obo_id AS id, trim(any_value(label)) AS label FROM go WHERE deprecated_at IS NULL GROUP BY obo_id HAVING count(DISTINCT trim(label)) = 1")
def s33_owl_map(spark: SparkSession, d: str) -> DataFrame:
    """One row a term, for terms delivered with one label."""
    x = _owl(spark, d).select("id", F.trim("label").alias("label"), "namespace", "parents")
    one = x.groupBy("id").agg(F.first("label").alias("label"), F.first("namespace").alias("namespace"), F.first("parents").alias("parents"), F.count_distinct("label").alias("n")).where("n = 1")
    return formats.owl_map(one.drop("n")).select("id", "label")


_GAF_LISTS = ("qualifier", "db_ref", "with_or_from", "synonym", "taxon", "annotation_extension")
_CLEAN = "trim(translate(coalesce({}, ''), chr(9) || chr(10) || chr(13), '   '))"


@query("SELECT " + ", ".join(f"array_to_string(list_filter(string_split({_CLEAN.format('gaf_' + c)}, '|'), lambda x: x <> ''), '|') AS {c}" if c in _GAF_LISTS else f"nullif({_CLEAN.format('gaf_' + c)}, '') AS {c}" for c in formats.GAF_COLUMNS)
       + f", try_cast(nullif(regexp_extract({_CLEAN.format('gaf_go_id')}, 'GO:([0-9]+)', 1), '') AS BIGINT) AS go_number FROM gaf")
def s34_gaf_file(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines with comments and blank lines between; tabs inside fields are written as spaces."""
    clean = lambda c: F.trim(F.translate(F.coalesce(F.col(f"gaf_{c}"), F.lit("")), "\t\n\r", "   "))
    line = F.concat_ws("\t", *[clean(c) for c in formats.GAF_COLUMNS])
    x = formats.read_gaf(spark, _texts(read_table(spark, d, "gaf").select(F.explode(F.array(F.lit("! note"), line, F.lit("")))), _folder(spark, "gaf")))
    return x.select(*[F.array_join(c, "|").alias(c) if c in _GAF_LISTS else F.col(c) for c in formats.GAF_COLUMNS], "go_number")


# --- interaction tables, services, manifests -----------------------------------------------------
@query("""SELECT l_orderkey::VARCHAR AS interaction_id, 's' || l_suppkey AS symbol_a, 'p' || l_partkey AS symbol_b, CASE WHEN l_linenumber % 2 = 0 THEN 'x,y' || l_linenumber ELSE '' END AS synonyms_a, CASE WHEN l_tax > 0 THEN l_tax END AS score FROM lineitem""")
def s35_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 24 columns."""
    li = read_table(spark, d, "lineitem")
    given = {"interaction_id": F.col("l_orderkey").cast("string"), "symbol_a": F.concat(F.lit("s"), "l_suppkey"), "symbol_b": F.concat(F.lit("p"), "l_partkey"), "synonyms_a": F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x|y"), "l_linenumber")), "score": F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string"))}
    line = F.concat_ws("\t", *[F.coalesce(given.get(c, F.lit(None).cast("string")), F.lit("-")) for c in formats.TAB2_COLUMNS])
    x = formats.tab2_records(li.select(line.alias("value")))
    return x.select("interaction_id", "symbol_a", "symbol_b", F.array_join("synonyms_a", ",").alias("synonyms_a"), "score")


@query("SELECT gaf_id AS row_id, mapped FROM gaf LEFT JOIN (SELECT gaf_db_id AS source, min(gaf_symbol) AS mapped FROM gaf GROUP BY ALL) ON gaf_db_id = source")
def s40_map_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids mapped in the order of the input, by way of the rows' number."""
    g = read_table(spark, d, "gaf")
    m = formats.map_ids(g.select(F.col("gaf_db_id").alias("id")).distinct(), g.select(F.col("gaf_db_id").alias("source"), F.col("gaf_symbol").alias("target")))
    return g.select(F.col("gaf_id").alias("row_id"), F.col("gaf_db_id").alias("i")).join(m, F.col("i").eqNullSafe(F.col("id")), "left").select("row_id", "mapped")


@query("SELECT md5(string_agg(file_name, '' ORDER BY track_id)) AS eid, coalesce(assay, '') AS celltype, '' AS target, count(*) AS n_files FROM tracks GROUP BY assay")
def s42_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests without an id: one an assay, with its files."""
    loc = F.transform(F.sort_array(F.collect_list(F.struct("track_id", F.col("file_name").alias("location")))), lambda v: F.struct(v["location"].alias("location")))
    j = read_table(spark, d, "tracks").groupBy("assay").agg(loc.alias("files")).select(F.to_json(F.struct(F.col("assay").alias("celltype"), "files")).alias("json"))
    return formats.manifest_files(j).select("eid", "celltype", "target", F.size("files").cast("bigint").alias("n_files"))


@query("SELECT n_nationkey, 'https://made.example/search/?searchTerm=' || replace(n_name, ' ', '+') || '&biosample_term_name=' || replace(n_name, ' ', '+') || '&frame=object&limit=all' AS url FROM nation")
def f8_search_urls(spark: SparkSession, d: str) -> DataFrame:
    """Search addresses for a parameter table (nation never grows)."""
    rows = read_table(spark, d, "nation").select("n_nationkey", "n_name").limit(1000).collect()
    return spark.createDataFrame([(r[0], (rest.terms(r[1]) + rest.cell_is(r[1]) + rest.terms(r[1])).url("https://made.example/")) for r in rows], "n_nationkey int, url string")


@query("SELECT event_id, CASE WHEN props IS NOT NULL THEN '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' END AS pretty FROM events")
def f9_pretty_json(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", formats.pretty_json(F.col("props")).alias("pretty"))
