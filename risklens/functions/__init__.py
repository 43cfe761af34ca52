from risklens.functions.time import (  # noqa: F401
    bucket_columns, epoch_micros, epoch_seconds_bucket_label,
)
