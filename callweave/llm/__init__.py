"""Operations for preparing large training corpora.

Nothing else in the library imports this subpackage.  Operators take and return
DataFrames, read only the columns they name, and ignore every other column.
"""
