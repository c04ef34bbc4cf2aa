"""quillpress: Markdown corpus shrinking and corpus measurement on Spark DataFrames."""

__version__ = "0.1.0"
