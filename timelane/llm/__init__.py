"""Operators for preparing training text, with queries over the test tables.

Nothing outside this folder imports it. The library's own records with text are saved mix
files, so the operators on text take a record's key as ``mix`` and its words as ``text``
unless told otherwise.
"""
