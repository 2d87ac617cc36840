"""lakescribe: table discovery, profiling, masking, lineage and snapshot comparison on Spark."""

from .policy import Policy
from .sources.workspace import Workspace

__all__ = ("Policy", "Workspace")
