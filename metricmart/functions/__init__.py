"""Scalar column expressions."""

from metricmart.functions.attributes import (any_value_text, attribute_entries, entries_text,
                                             entries_to_map, map_text, service_name)
from metricmart.functions.identity import (identity_text, identity_text_from_maps,
                                           metric_hash, series_key, unsigned_hash_text)
from metricmart.functions.points import (floor_div, nanos_to_date, nanos_to_timestamp,
                                         point_value, unsigned_nanos)
from metricmart.functions.text import go_float_text, go_quote

__all__ = [
    "any_value_text", "attribute_entries", "entries_text", "entries_to_map", "map_text",
    "service_name", "identity_text", "identity_text_from_maps", "metric_hash", "series_key",
    "unsigned_hash_text", "floor_div", "nanos_to_date", "nanos_to_timestamp", "point_value",
    "unsigned_nanos", "go_float_text", "go_quote",
]
