from risklens.streaming.frequency import stream_access_frequency  # noqa: F401
