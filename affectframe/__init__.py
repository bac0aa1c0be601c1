"""Text analytics on short posts, written for Spark DataFrames."""

from affectframe.session import get_spark, new_dir, shared_dir

__all__ = ["get_spark", "new_dir", "shared_dir"]
