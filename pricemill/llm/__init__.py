"""Operators for preparing text corpora; nothing else in the package imports them.

Rules that hold for every operator here: other columns of the input stay as they are, but one with
the name of a result column is replaced (``_llm_`` begins the names of helper columns); a null text counts as an empty one unless an
operator says otherwise; rows with equal ids are rows of one document; an empty table gives an
empty table of the same columns.
"""
