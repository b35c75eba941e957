from tidewell.streaming.state import append_once, cooled_stream, matured, threshold_stream
from tidewell.streaming.windows import hourly_counts, late_tolerant_totals

__all__ = ["append_once", "cooled_stream", "hourly_counts", "late_tolerant_totals", "matured", "threshold_stream"]
