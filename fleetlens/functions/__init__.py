"""Column functions: each takes and returns Spark columns and stays inside code generation."""

from fleetlens.functions.display import (  # noqa: F401
    display_name, is_valid_prefix, panel_round, percent_used, threshold_colour, threshold_colour_from,
)
from fleetlens.functions.engines import (  # noqa: F401
    engine_short_name, is_valid_engine, normalize_engine, statement_family,
)
from fleetlens.functions.labels import (  # noqa: F401
    dimension_sample_name, dimension_value, label_map, tag_map, truncate_label,
)
from fleetlens.functions.metrics import (  # noqa: F401
    emitted_name, metric_category, parse_statistic, sanitize, split_metric,
)
from fleetlens.functions.statements import (  # noqa: F401
    io_time_ms, lock_time_ms, lock_time_ms_true, query_digest, statement_text, wait_ms,
)
from fleetlens.functions.text import exposition_number, java_regex  # noqa: F401
