"""Column functions, each with the semantics of the workload model."""
