"""Import every module that registers queries."""

from .eventlog import queries as eventlog_queries  # noqa: F401
from .functions import queries as scalar_queries  # noqa: F401
from .operators import aggregates, joins, projection, sorting, windows  # noqa: F401
from .ml import queries as ml_queries  # noqa: F401
from .plans import basket_reports, channel_reports, mart_tables, star_reports, suite, tax_returns  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from .sources import queries as source_queries  # noqa: F401
from .streaming import queries as streaming_queries  # noqa: F401
