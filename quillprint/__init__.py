"""Fingerprints of text-generating models, computed as Spark DataFrame jobs."""

from quillprint.config import RunConfig
from quillprint.session import build_session

__all__ = ["RunConfig", "build_session"]
