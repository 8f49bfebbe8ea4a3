"""helixframe: a Spark-native engine for genomic intervals, sequences, motifs and their data hygiene."""

__version__ = "0.1.0"
