"""risklens: access-regularity, entity-graph, association-rule and classifier
operators written against the PySpark DataFrame API.

Operators take and return DataFrames. Most are lazy; iterative graph operators
and model fits run jobs while they are called. No operator collects data to the
driver beyond scalars.
"""

from risklens.session import build_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
