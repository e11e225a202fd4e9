"""All operators, ready to configure."""

from .algebra import *  # noqa: F403
from .registry import REGISTRY, Op, catalog, directed_support, operator  # noqa: F401
from .selection import *  # noqa: F403
from .structure import *  # noqa: F403
