"""What runs before Spark plans: predicates, their parser, file pruning, SQL text."""
