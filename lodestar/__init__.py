"""A PySpark engine for questions over code facts and text: call graphs, flow, search, vectors, versioned edges, statistics."""
