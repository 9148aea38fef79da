"""Training-data operators: ten distributed building blocks over text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with its
own general interface; ``queries`` binds them to the tables of a data folder.
"""
