"""churnscope: subscription analytics expressed as Spark DataFrame plans.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a tiny
driver-side value such as a fitted model) and is built from native column
expressions, so Catalyst sees the whole plan and keeps it inside whole-stage
codegen.
"""

from churnscope.roles import ROLES, identity_mapping
from churnscope.session import build_session, checkpoint_dir

__all__ = ["ROLES", "identity_mapping", "build_session", "checkpoint_dir"]
