"""Session set-up and lineage control shared by all operators."""

from vellichor.plans.lineage import materialize, scratch_dir
from vellichor.plans.session import default_session

__all__ = ["default_session", "materialize", "scratch_dir"]
