"""Built-in metrics. Modules here register themselves when imported."""
