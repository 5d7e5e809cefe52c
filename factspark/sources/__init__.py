"""What queries read: mapped tables, fact stores, collections, and filtered views of them."""

from .base import Rel, Source  # noqa: F401
from .collection import CollectionSource  # noqa: F401
from .mapped import MappedSource, Table, tpch_tables  # noqa: F401
