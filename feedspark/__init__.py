"""feedspark: news-feed analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

from .constants import TOPICS  # noqa: F401
from .session import get_session, prepare  # noqa: F401

__version__ = "0.1.0"
