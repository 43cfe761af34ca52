"""Default parameters of the operators."""

# The settings of the original jobs.
HISTOGRAM_BINS = 100
QUANTILE = 0.8
QUANTILE_RELATIVE_ERROR = 0.001
LOUVAIN_MAX_ITER = 5
LOUVAIN_LAYERS = 2
LABEL_PROPAGATION_STEPS = 5
FP_MIN_SUPPORT = 0.01
FP_MIN_CONFIDENCE = 0.0
VECTOR_MAX_CATEGORIES = 4

# Own choices (not from the jobs).
GAP_CHUNK_SECONDS = 60
# Louvain gain uses the total weight m where the textbook uses 2m, which is
# resolution 2 in the textbook formula.
LOUVAIN_RESOLUTION = 2.0
