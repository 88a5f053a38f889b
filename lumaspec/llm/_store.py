"""Tables written in the shared folder of the cluster, as in the rest of the library."""

from ..store import cut, discard, discard_all, new_path, shared_dir

__all__ = ["cut", "discard", "discard_all", "new_path", "shared_dir"]
