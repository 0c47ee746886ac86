"""Full-text search over ordinary Spark tables."""

from .operators.index import CacheError, Index, IndexNotBuiltError
from .operators.search import Searcher

__all__ = ["CacheError", "Index", "IndexNotBuiltError", "Searcher"]
