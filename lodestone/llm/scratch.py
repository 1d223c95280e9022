"""Tables written between jobs; see `lodestone.staging`."""

from __future__ import annotations

from lodestone.staging import forget, setting, shared_dir, shuffle_partitions, written

__all__ = ["forget", "setting", "shared_dir", "shuffle_partitions", "written"]
