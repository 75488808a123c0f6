"""wirelight: security telemetry on Spark.

Reads DNS, connection, HTTP and TLS records from sensor logs, packet captures
and landed search documents, decides which of them are in monitoring scope,
suppresses repeated DNS queries and formats alerts.  Everything is expressed as
DataFrame transformations, so the same functions run in batch and streaming.
"""

from wirelight.session import configure, work_dir

__version__ = "0.1.0"
__all__ = ["configure", "work_dir", "__version__"]
