"""Operators for preparing large text corpora for language-model training.

One module per operator; ``queries`` registers the query of each. Nothing in
the rest of the library imports this subpackage.
"""
