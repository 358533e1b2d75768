"""DataFrame-in, DataFrame-out operators; series keys are passed as column lists."""
