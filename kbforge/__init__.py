"""kbforge: build, search and evaluate a text knowledge base on Spark.

Every operator takes and returns DataFrames (or Columns).  Nothing here
collects a table to the driver; the only driver-side actions are bounded
size checks before a broadcast and the convergence count of iterative
community detection.
"""

from kbforge.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
