"""Position weight matrices: scoring, score distributions, scanning, alignment and merging."""
