"""Graph operators on edge DataFrames ``(src long, dst long, weight double)``.

GraphX has no Python API, so every algorithm is a loop of DataFrame joins and
aggregations; each round cuts its lineage with a reliable checkpoint.
"""

from risklens.operators.graph.build import (  # noqa: F401
    cooccurrence_edges, distinct_focus, entity_graph, graph_vertices, seed_labels,
    similarity_edges, total_weight, union_edges, vertex_strength,
)
from risklens.operators.graph.cells import (  # noqa: F401
    cell_components, cell_seed_probability, cell_strength, cell_total_weight, cell_vertices,
    record_strength, shared_cells, similarity_cells,
)
from risklens.operators.graph.cell_lpa import cell_bm_label_propagation, cell_label_propagation  # noqa: F401
from risklens.operators.graph.sharing import cell_density, cell_sets, sharing_pairs  # noqa: F401
from risklens.operators.graph.components import connected_components  # noqa: F401
from risklens.operators.graph.lpa import (  # noqa: F401
    bm_label_propagation, label_propagation, seed_probability,
)
from risklens.operators.graph.community import (  # noqa: F401
    best_moves, communities, louvain, louvain_coarsen, louvain_init, louvain_local,
    modularity,
)
from risklens.operators.graph.report import (  # noqa: F401
    community_density, fraud_groups, fraud_members, fraud_summary, grey_list,
    grey_list_from_seeds, vertex_verdict,
)
