"""tessera: tabular customer analytics on Spark DataFrames.

Load -> profile -> clean -> prepare -> segment -> classify -> evaluate.
Every step takes and returns Spark DataFrames; fitted state is a small
parameter table or an MLlib model.
"""

from tessera.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
