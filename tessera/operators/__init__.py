"""The relational operators as functions from DataFrame to DataFrame, for use without SQL text.

They only declare plans; Catalyst picks the physical ones. Semantics are the engine's: three-valued logic, division of
integers towards zero, NULL lowest in order, keys that are NULL join with nothing.
"""

from .expressions import cast_to, div, in_list, is_false, is_true, like
from .relational import aggregate, anti_join, exists, filter_rows, join, limit, not_exists, not_in, point_read, project, scan, semi_join, sort, values

__all__ = [
    "aggregate", "anti_join", "cast_to", "div", "exists", "filter_rows", "in_list", "is_false", "is_true", "join", "like", "limit", "not_exists", "not_in", "point_read",
    "project", "scan", "semi_join", "sort", "values",
]
