"""DataFrame operators: edges and graphs, retrieval, briefs, incremental indexing, memory."""
