"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

from barspark.storage import shared_folder, stored

__all__ = ["shared_folder", "stored"]
