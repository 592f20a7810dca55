"""DataFrame operators: extraction, filters, decisions, totals, comparison."""
