"""Tables and files in the folder that the driver and all executors share."""

from ..sources.storage import checked, cut, drop, new_path, shared_dir

__all__ = ["checked", "cut", "drop", "new_path", "shared_dir"]
