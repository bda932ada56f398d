"""Column-level functions. Each returns a Column and runs inside any DataFrame job."""
