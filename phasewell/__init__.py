"""phasewell: haplotype-resolved read analytics and corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
