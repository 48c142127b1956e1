"""The question library: DataFrame in, DataFrame out.

Most operators take ``by``: columns that separate independent people (for example
``["owner"]``). Empty means the table holds one person's data.
"""
