"""Slice-stack and voxel analytics as PySpark DataFrame operators."""

from voxelloom.session import build_session

__all__ = ["build_session"]
