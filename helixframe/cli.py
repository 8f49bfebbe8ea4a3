"""Command line: ``python -m helixframe.cli scan-motif | mkindex | merge-motifs ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from helixframe.motif.align import aligner, build_tree, cut_tree, dilute, iterative_merge, merge_tree
from helixframe.motif.pwm import Motif
from helixframe.motif.scan import cutoff_motif, pairwise_distances, scan_regions
from helixframe.runtime import session
from helixframe.sources.codecs import print_bed, read_bed
from helixframe.sources.formats import motif_table, parse_meme, parse_motif_fasta, to_meme, to_motif_fasta
from helixframe.sources.genome import get_seq, make_index, open_genome


def load_motifs(path: str) -> list[Motif]:
    """Motifs of a MEME or motif-FASTA file, by suffix."""
    with open(path) as f:
        text = f.read()
    return parse_meme(text) if path.endswith((".meme", ".txt")) else parse_motif_fasta(text)


def save_motifs(path: str, motifs: list[Motif]) -> None:
    """The inverse of :func:`load_motifs`."""
    with open(path, "w") as f:
        f.write(to_meme(motifs) if path.endswith((".meme", ".txt")) else to_motif_fasta(motifs))


def scan_motif(genome: str, motifs: str, bed: str, p: float = 1e-5, out=None) -> None:
    """Print the motif hits in the regions of a BED file."""
    spark = session("scan-motif")
    regions = read_bed(spark, bed, "bed3").withColumn("region_id", F.monotonically_increasing_id())
    hits = scan_regions(get_seq(regions, open_genome(spark, genome)), [cutoff_motif(m, p) for m in load_motifs(motifs)])
    print_bed(hits, "bed", out)


def merge_motifs(motifs: list[Motif], align, *, mode: str = "iter", threshold: float = 0.2, diluted: bool = False) -> list[Motif]:
    """Merge similar motifs, pair by pair (``iter``) or along a guide tree (``tree``); names are joined by ``+``.

    ``diluted`` writes matrices with their weak rows drawn to the background (``iter`` only).
    """
    if mode == "iter":
        return [Motif("+".join(n), dilute(m, w) if diluted else m) for n, m, w in iterative_merge(align, threshold, motifs)]
    return [Motif("+".join(m.name for m in t.leaves()), merge_tree(align, t)[0]) for t in cut_tree(build_tree(align, motifs), threshold)]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="helixframe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("scan-motif")
    a.add_argument("genome"), a.add_argument("motifs"), a.add_argument("bed"), a.add_argument("-p", type=float, default=1e-5)
    a = sub.add_parser("mkindex")
    a.add_argument("out"), a.add_argument("fasta")
    a = sub.add_parser("merge-motifs")
    a.add_argument("what", choices=["merge", "dist", "cluster"])
    a.add_argument("motifs"), a.add_argument("other", nargs="?")
    a.add_argument("-o", "--out"), a.add_argument("--mode", choices=["iter", "tree"], default="iter"), a.add_argument("--threshold", type=float, default=0.2)
    a.add_argument("--penalty", choices=["linear", "quadratic", "cubic", "exp"], default="exp"), a.add_argument("--gap", type=float, default=0.05)
    a.add_argument("--average", choices=["l1", "l2", "l3", "max"], default="l1"), a.add_argument("--dilute", action="store_true")
    o = ap.parse_args(argv)
    if o.cmd == "scan-motif":
        scan_motif(o.genome, o.motifs, o.bed, o.p)
    elif o.cmd == "mkindex":
        make_index(session("mkindex"), o.fasta, o.out)
    else:
        opts = {"penalty": o.penalty, "gap": o.gap, "combine": o.average}
        ms = load_motifs(o.motifs)
        if o.what == "dist":
            spark = session("motif-distances")
            d = pairwise_distances(motif_table(spark, ms), motif_table(spark, load_motifs(o.other)) if o.other else None, **opts)
            for r in d.orderBy("a", "b").toLocalIterator():
                print(r["a"], r["b"], r["distance"], sep="\t")
        elif o.what == "cluster":
            for t in cut_tree(build_tree(aligner(**opts), ms), o.threshold):
                print(*(m.name for m in t.leaves()), sep="\t")
        else:
            done = merge_motifs(ms, aligner(**opts), mode=o.mode, threshold=o.threshold, diluted=o.dilute)
            save_motifs(o.out, done) if o.out else sys.stdout.write(to_meme(done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
