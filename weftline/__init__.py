"""weftline: record linkage, profiling and knowledge-graph analytics as DataFrame transformations."""
