from .features_stream import feature_stream
from .metrics_stream import metric_stream, stream_metrics

__all__ = ["feature_stream", "metric_stream", "stream_metrics"]
