"""tidemark: release diffs, ownership graphs and return panels as Spark jobs."""

__version__ = "0.1.0"
