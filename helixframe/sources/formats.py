"""Text formats read with Spark's own readers: GTF, GAF, ontology XML, MEME, interaction tables, manifests, JSON."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.motif.pwm import UNIFORM, Motif

#: Fixed names of the 17 columns.
GAF_COLUMNS = "db db_id symbol qualifier go_id db_ref evidence_code with_or_from aspect name synonym type taxon date assigned_by annotation_extension gene_product_id".split()
#: Fixed names of the 24 columns of the interaction table.
TAB2_COLUMNS = "interaction_id entrez_a entrez_b biogrid_a biogrid_b systematic_a systematic_b symbol_a symbol_b synonyms_a synonyms_b system system_type author pubmed_id organism_a organism_b throughput score modification phenotypes qualifications tags source".split()
_LISTS = {"synonyms_a", "synonyms_b", "phenotypes", "qualifications", "tags"}
_GAF_LISTS = {"db_ref", "with_or_from", "synonym", "taxon", "annotation_extension", "qualifier"}


# --- gene models ---------------------------------------------------------------------------------
def gtf_elements(lines: DataFrame) -> DataFrame:
    """Gene, transcript, exon and utr lines (``value``, ``line_no``) as columns; 0-based, inclusive on the right.

    Feature names are compared without case; other features, comments and blank lines are left out. A
    gene without ``gene_id`` or ``gene_name``, or another element without ``transcript_id``, raises.
    """
    f = lambda i: F.get(F.split("value", "\t"), F.lit(i - 1))
    x = lines.where(~F.col("value").rlike(r"\A(#|\z)")).select("line_no", F.lower(f(3)).alias("feature"), f(1).alias("chrom"), f(4).alias("l"), f(5).alias("r"), f(7).alias("st"), f(9).alias("attr"))
    x = x.where(F.col("feature").isin("gene", "transcript", "exon", "utr"))
    raw = lambda k: F.regexp_extract("attr", rf'(?:\A|;) *{k} +"([^"]*)"', 1)
    has = lambda k: F.col("attr").rlike(rf"(?:\A|;) *{k} ")
    need = lambda k, when: F.when(has(k), raw(k)).otherwise(F.when(when, F.raise_error(F.lit(f"no {k}")).cast("string")))
    gene = F.col("feature") == "gene"
    ty = F.when(has("transcript_type"), raw("transcript_type"))
    return x.select("line_no", "feature", "chrom", (F.col("l").cast("bigint") - 1).alias("left"), (F.col("r").cast("bigint") - 1).alias("right_incl"), (F.col("st") == "+").alias("strand"),
        need("gene_id", gene | (F.col("feature") == "transcript")).alias("gene_id"), need("gene_name", gene).alias("gene_name"), need("transcript_id", ~gene).alias("transcript_id"), F.coalesce(ty == "protein_coding", F.lit(True)).alias("coding"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Elements of GTF files; ``line_no`` grows within a file."""
    return gtf_elements(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


# --- ontology ------------------------------------------------------------------------------------
def gaf_columns(fields: str) -> list[Column]:
    """The 17 columns from an array of 17 fields, and the number of the GO id; empty ones are NULL, lists are split at ``|``."""
    one = lambda i: F.nullif(F.get(fields, F.lit(i)), F.lit(""))
    cols = [(F.filter(F.split(F.coalesce(one(i), F.lit("")), r"\|"), lambda v: v != "") if c in _GAF_LISTS else one(i)).alias(c) for i, c in enumerate(GAF_COLUMNS)]
    return [*cols, F.regexp_extract(F.get(fields, F.lit(4)), r"GO:(\d+)", 1).try_cast("bigint").alias("go_number")]


def gaf_records(lines: DataFrame) -> DataFrame:
    """The 17 columns of annotation lines, lists split at ``|``; comments and blank lines are left out anywhere."""
    x = lines.where(~F.col("value").rlike(r"\A(!|\s*\z)")).withColumn("f", F.split("value", "\t"))
    x = x.withColumn("f", F.when(F.size("f") == 17, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not 17 columns: "), F.col("value"))).cast("array<string>")))
    return x.select(*gaf_columns("f"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files (GAF 2.1)."""
    return gaf_records(spark.read.text(path))


_OWL = """`_about` string, `owl:deprecated` struct<_VALUE:string>, `rdfs:label` array<struct<_VALUE:string>>, `oboInOwl:id` array<struct<_VALUE:string>>,
 `oboInOwl:hasOBONamespace` array<struct<_VALUE:string>>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>, `_rdf:about` string"""


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """Terms of ontology XML that are not deprecated: ``id, label, namespace, parents`` (array of ids).

    Anonymous super-classes have no resource and are left out. Duplicate ids stay; :func:`owl_map` rejects them.
    """
    x = spark.read.format("xml").option("rowTag", "owl:Class").schema(_OWL).load(path)
    first = lambda c: F.get(F.col(f"`{c}`._VALUE"), F.lit(0))
    num = lambda c: F.regexp_extract(c, r"(\d+)\z", 1).try_cast("bigint")
    parents = F.filter(F.transform(F.coalesce(F.col("`rdfs:subClassOf`.`_rdf:resource`"), F.array().cast("array<string>")), num), lambda v: v.isNotNull())
    y = x.where(F.col("`owl:deprecated`").isNull())
    return y.select(num(F.coalesce(first("oboInOwl:id"), F.col("`_rdf:about`"))).alias("id"), first("rdfs:label").alias("label"), first("oboInOwl:hasOBONamespace").alias("namespace"), parents.alias("parents")).where("id IS NOT NULL")


def owl_map(terms: DataFrame) -> DataFrame:
    """The same, one row per id; a repeated id raises."""
    g = terms.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("namespace").alias("namespace"), F.first("parents").alias("parents"))
    return g.select(F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate term")).cast("bigint")).otherwise(F.col("id")).alias("id"), "label", "namespace", "parents")


# --- interaction tables, id maps, JSON -----------------------------------------------------------
def tab2_records(lines: DataFrame) -> DataFrame:
    """The 24 columns of interaction lines; ``-`` is NULL, lists are split at ``|``; header lines are left out."""
    x = lines.where(~F.col("value").rlike(r"\A(#|\s*\z)")).withColumn("f", F.split("value", "\t"))
    one = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit("-"))
    cols = []
    for i, c in enumerate(TAB2_COLUMNS):
        v = one(i)
        v = F.filter(F.split(F.coalesce(v, F.lit("")), r"\|"), lambda s: s != "") if c in _LISTS else v.cast("double") if c == "score" else v
        cols.append(v.alias(c))
    return x.select(*cols)


def map_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """``id, mapped`` for every row of ``ids``; unknown ones get NULL. ``mapping``: ``source, target``, of repeats the smallest target."""
    m = mapping.groupBy("source").agg(F.min("target").alias("mapped"))
    return ids.join(m, F.col("id") == F.col("source"), "left").select("id", "mapped")


def json_path(c: Column, path: str, kind: str = "string", *, strict: bool = True) -> Column:
    """A value of a JSON text by path (``$.a[0]``); ``strict`` raises where there is none or it does not fit."""
    v = F.try_variant_get(F.try_parse_json(c), path, kind)
    return F.coalesce(v, F.raise_error(F.concat(F.lit(f"no {path} in "), F.coalesce(c, F.lit("NULL")))).cast(kind)) if strict else v


def pretty_json(c: Column) -> Column:
    """JSON text, indented, keys in the order given; NULL for NULL."""

    @F.pandas_udf("string")
    def indent(t):
        return t.map(lambda s: json.dumps(json.loads(s), indent=2, ensure_ascii=False), na_action="ignore")

    return indent(c)


def manifest_files(df: DataFrame, column: str = "json") -> DataFrame:
    """Experiment manifests: ``eid, celltype, target, files`` with defaults, and an id made from the file locations if none is given."""
    file_ = "struct<location:string, format:string, info:map<string,string>, tags:array<string>, replication:int>"
    x = df.select(F.from_json(column, f"struct<id:string, celltype:string, target:string, files:array<{file_}>>").alias("m"))
    files = F.coalesce("m.files", F.array().cast(f"array<{file_}>"))
    return x.select(F.coalesce("m.id", F.md5(F.concat_ws("", F.transform(files, lambda f: f["location"])))).alias("eid"), F.coalesce("m.celltype", F.lit("")).alias("celltype"), F.coalesce("m.target", F.lit("")).alias("target"), files.alias("files"))


# --- motif files ---------------------------------------------------------------------------------
def parse_meme(text: str) -> list[Motif]:
    """Motifs of a MEME text. A block ends at a blank line, a URL line, the next motif or the end."""
    out: list[Motif] = []
    name, sites, rows = None, None, None
    for line in [*text.splitlines(), ""]:
        s = line.strip()
        if rows is not None and (not s or s.startswith(("URL", "MOTIF"))):
            out.append(Motif(name, np.array(rows), sites))
            name = rows = None
        if line.startswith("MOTIF"):
            name = line[6:]
        elif name is not None and line.startswith("letter-probability matrix:"):
            m = re.search(r"nsites= *(\d+)", line)
            sites, rows = int(m[1]) if m else None, []
        elif rows is not None:
            rows.append([float(v) for v in s.split()])
    return out


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """Motif table ``name, n_sites, mat`` of MEME files, each parsed in one task."""
    @F.pandas_udf("array<struct<name:string,n_sites:int,mat:array<array<double>>>>")
    def parse(t):
        return t.map(lambda s: [{"name": m.name, "n_sites": m.n_sites, "mat": m.mat.tolist()} for m in parse_meme(s)])

    return spark.read.text(path, wholetext=True).select(F.explode(parse("value")).alias("m")).select("m.*")


def _row(r) -> str:
    return " ".join(repr(float(v)).removesuffix(".0") for v in r)


def to_meme(motifs: list[Motif], bg=UNIFORM) -> str:
    """MEME text of motifs (version 4, E fixed at 0)."""
    head = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\n" + " ".join(f"{c} {p:f}" for c, p in zip("ACGT", bg, strict=True)) + "\n\n"
    return head + "".join(f"MOTIF {m.name}\nletter-probability matrix: alength= 4 w= {len(m.mat)} nsites= {1 if m.n_sites is None else m.n_sites} E= 0\n" + "".join(f" {_row(r)}\n" for r in m.mat) + "\n" for m in motifs)


def parse_motif_fasta(text: str) -> list[Motif]:
    """Motifs written as ``>name`` and rows of four numbers."""
    out = []
    for block in re.split(r"(?m)^>", text)[1:]:
        head, *rows = block.splitlines()
        out.append(Motif(head.strip(), np.array([[float(v) for v in r.split()] for r in rows if r.strip()])))
    return out


def to_motif_fasta(motifs: list[Motif]) -> str:
    """The inverse of :func:`parse_motif_fasta`."""
    return "".join(f">{m.name}\n" + "".join(_row(r) + "\n" for r in m.mat) + "\n" for m in motifs)


def motif_table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """Motifs as a DataFrame ``name, n_sites, mat``."""
    return spark.createDataFrame([(m.name, m.n_sites, m.mat.tolist()) for m in motifs], "name string, n_sites int, mat array<array<double>>")


def collect_motifs(df: DataFrame, most: int = 10_000) -> list[Motif]:
    """Motifs of a table on the driver; more than ``most`` are refused."""
    rows = df.select("name", "n_sites", "mat").orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} motifs")
    return [Motif(r[0], np.array(r[2], dtype=float), r[1]) for r in rows]
