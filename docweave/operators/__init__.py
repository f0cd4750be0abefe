"""DataFrame operators: retrieval, ranking, graph, context, answers, checks, evaluation."""
