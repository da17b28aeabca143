"""DataFrame operators. A fit returns a small table; an apply joins or folds it back."""
