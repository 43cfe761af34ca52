from risklens.sources.readers import (  # noqa: F401
    ACCESS_LOG_SCHEMA, read_access_log, read_baskets_text, read_edge_list,
    read_libsvm, read_table, read_testdata, save_bucketed, scan_access_log,
    write_result, write_slices,
)
