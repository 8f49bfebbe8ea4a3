"""Catalogues of queries with their SQL counterparts."""

from helixframe.plans import columns, files, genomics, motifs, problems

CATALOGUES = [genomics, columns, files, motifs, problems]
