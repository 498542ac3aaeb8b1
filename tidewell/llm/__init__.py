"""Training-data pipeline operators.

Ten operators on documents, web pages and conversations.  Nothing outside this
subpackage imports it; `queries` holds the registered queries.
"""
