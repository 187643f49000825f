"""Network analytics of mixtures, targets and diseases as lazy Spark DataFrame operators."""
