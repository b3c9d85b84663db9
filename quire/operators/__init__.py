"""DataFrame and Column operators, one module per stage of the corpus."""
