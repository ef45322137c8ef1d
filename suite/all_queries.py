"""Importing this module registers every query."""

from suite import detection  # noqa: F401
from suite import masking  # noqa: F401
from suite import evaluation  # noqa: F401
from suite import corpus  # noqa: F401
from suite import usage  # noqa: F401
from suite import jobs  # noqa: F401
from suite import streams  # noqa: F401
