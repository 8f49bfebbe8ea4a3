"""Gene models, promoters, regulatory domains, ontology levels and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.functions.stats import hyperquick, with_neighbours
from helixframe.operators.cycles import cycle_terms, longest_ways
from helixframe.runtime import materialize


def gene_models(elements: DataFrame) -> DataFrame:
    """Genes with nested, sorted, distinct transcripts, exons and UTRs.

    ``elements``: ``line_no, feature, chrom, left, right_incl, strand, gene_id, gene_name,
    transcript_id, coding`` (see :func:`helixframe.sources.formats.read_gtf`). Of genes (transcripts)
    with one id the first (last) line counts; transcripts, exons and UTRs without their parent are
    dropped. Coordinates are 0-based and inclusive on the right.
    """
    e = elements
    part = lambda f: e.where(F.col("feature") == f).groupBy("transcript_id").agg(F.sort_array(F.collect_set(F.struct("left", F.col("right_incl").alias("right")))).alias(f))
    first = lambda d, key, cols, pick: d.groupBy(key).agg(pick(F.struct(*cols), "line_no").alias("x")).select(key, "x.*")
    tr = first(e.where("feature = 'transcript'"), "transcript_id", ["gene_id", "left", "right_incl", "strand", "coding"], F.min_by)
    none = F.array().cast("array<struct<left:bigint,right:bigint>>")
    tr = tr.join(part("exon"), "transcript_id", "left").join(part("utr"), "transcript_id", "left")
    t = F.struct("transcript_id", "left", F.col("right_incl").alias("right"), "strand", F.coalesce("exon", none).alias("exons"), F.coalesce("utr", none).alias("utrs"), "coding")
    per = tr.groupBy("gene_id").agg(F.sort_array(F.collect_set(t)).alias("transcripts"))
    g = first(e.where("feature = 'gene'"), "gene_id", ["gene_name", "chrom", "left", "right_incl", "strand"], F.min_by)
    return g.join(per, "gene_id", "left").select("gene_name", "gene_id", "chrom", "left", "right_incl", "strand", F.coalesce("transcripts", F.array().cast(per.schema["transcripts"].dataType)).alias("transcripts"))


def promoters(genes: DataFrame, up: int, down: int) -> DataFrame:
    """Windows around the distinct transcription start sites: BED3, ``tss, gene_name``; starts are kept at 0 or above."""
    ends = F.when(F.col("strand"), F.array_append(F.transform("transcripts", lambda t: t["left"]), F.col("left"))).otherwise(F.array_append(F.transform("transcripts", lambda t: t["right"]), F.col("right_incl")))
    x = genes.select("chrom", "strand", "gene_name", F.explode(F.array_distinct(ends)).alias("tss"))
    lo, hi = F.when(F.col("strand"), up).otherwise(down), F.when(F.col("strand"), down).otherwise(up)
    return x.select("chrom", F.greatest(F.lit(0), F.col("tss") - lo).alias("chrom_start"), (F.col("tss") + hi).alias("chrom_end"), "tss", "gene_name")


def regulatory_domains(proms: DataFrame, ext: int, tie: str, *, every_third: bool = False) -> DataFrame:
    """Stretches on both sides of each promoter up to its neighbours, ``ext`` at most: the columns of ``proms``.

    Neighbours are the rows before and after in (start, end, ``tie``) on the same chrom, found without a
    window over a chrom. Empty sides are left out. ``every_third`` keeps the domains of every third
    promoter only, counted over the sorted table, as the original interface returned them.
    """
    x = with_neighbours(proms, ["chrom", "chrom_start", "chrom_end", tie], ["chrom", "chrom_start", "chrom_end"])
    x = x.withColumn("__le", F.when(F.col("prev_chrom") == F.col("chrom"), F.col("prev_chrom_end"))).withColumn("__rs", F.when(F.col("next_chrom") == F.col("chrom"), F.col("next_chrom_start")))
    if every_third:
        x = x.where(F.pmod("__k", F.lit(3)) == 0)
    s, e = F.col("chrom_start"), F.col("chrom_end")
    left = F.when(F.col("__le").isNull(), F.greatest(s - ext, F.lit(0))).otherwise(F.least(s, F.greatest(s - ext, F.col("__le"))))
    right = F.when(F.col("__rs").isNull(), e + ext).otherwise(F.greatest(e, F.least(e + ext, F.col("__rs"))))
    sides = F.explode(F.array(F.struct(left.alias("a"), s.alias("z")), F.struct(e.alias("a"), right.alias("z"))))
    rest = [c for c in proms.columns if c not in ("chrom", "chrom_start", "chrom_end")]
    return x.select("chrom", sides.alias("d"), *rest).where("d.z > d.a").select("chrom", F.col("d.a").alias("chrom_start"), F.col("d.z").alias("chrom_end"), *rest)


def go_levels(starts: DataFrame, links: DataFrame) -> DataFrame:
    """``id, level``: length of the longest way up from each id, 0 without parents or for unknown ids.

    ``links`` has ``child, parent``; a parent that is not known itself still counts one level. One value a
    term is kept (see :func:`helixframe.operators.cycles.longest_ways`). A cycle anywhere raises.
    """
    known, rest = longest_ways(links)
    if not rest.isEmpty():
        raise ValueError("the hierarchy has a cycle")
    ids = starts.select("id").distinct()
    return ids.join(known, F.col("id") == F.col("v"), "left").select("id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def term_levels(terms: DataFrame, links: DataFrame) -> DataFrame:
    """``id, node_state, level`` for links that may hold cycles.

    ``free``: the level of :func:`go_levels`. A term on a cycle (``on_cycle``) or with any way up to
    one (``below_cycle``) has no longest way; its level is -1. Links of children that are no terms are
    ignored; an unknown parent counts one level.
    """
    ids = materialize(terms.select(F.col("id").cast("bigint")).where("id IS NOT NULL").distinct(), "terms")
    lk = links.select(F.col("child").cast("bigint"), F.col("parent").cast("bigint")).where("parent IS NOT NULL").distinct()
    known, rest = longest_ways(materialize(lk.join(ids, F.col("child") == F.col("id"), "left_semi"), "links"))
    cyc = cycle_terms(rest).select(F.col("id").alias("c"))
    bad = materialize(rest.select(F.col("child").alias("r")).distinct().join(cyc, F.col("r") == F.col("c"), "left"), "endless")
    x = ids.join(known, F.col("id") == F.col("v"), "left").join(bad, F.col("id") == F.col("r"), "left")
    state = F.when(F.col("c").isNotNull(), "on_cycle").when(F.col("r").isNotNull(), "below_cycle").otherwise("free")
    return x.select("id", state.alias("node_state"), F.when(F.col("r").isNotNull(), -1).otherwise(F.coalesce("level", F.lit(0))).cast("int").alias("level"))


def enrichment(annotated: DataFrame, foreground: DataFrame) -> DataFrame:
    """Terms over-represented among the foreground items: ``term, x, m, n, total, fold_change, p_value``.

    ``annotated`` has distinct ``item, term`` pairs, ``foreground`` has ``item``. P = 1 - P(X <= x - 1).
    """
    a = annotated.select("item", "term").distinct()
    fg = foreground.select(F.col("item").alias("f")).distinct()
    items = a.select("item").distinct()
    total = items.agg(F.count(F.lit(1)).alias("c")).scalar()
    n = items.join(fg, F.col("item") == F.col("f"), "left_semi").agg(F.count(F.lit(1)).alias("c")).scalar()
    g = a.join(fg, F.col("item") == F.col("f"), "left").groupBy("term").agg(F.count(F.lit(1)).alias("m"), F.count("f").alias("x"))
    g = g.where("x > 0").withColumn("n", n).withColumn("total", total)
    fold = F.try_divide(F.col("x") * F.col("total").cast("double"), F.col("m") * F.col("n"))
    return g.select("term", "x", "m", "n", "total", fold.alias("fold_change"), (1 - hyperquick(F.col("x") - 1, "m", "n", "total")).alias("p_value"))
