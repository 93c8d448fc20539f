"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; `queries` binds the operators to the tables of a data folder.
"""
