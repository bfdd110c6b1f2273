"""Training-data operators: dedup, scans, filters, packing, sharding.

Nothing else in the library imports this subpackage. Rules that hold for every operator here:

* inputs are ``documents``-like frames; an operator selects the columns it needs first, so extra columns never clash;
* a null text counts as an empty one, a null doc_id is an ordinary value that equals no other document's id;
* repeated rows each give a row of their own; empty tables give empty results with the same schema;
* tables that are read twice are written to the folder in ``spark.checkpoint.dir`` (see :mod:`loomwork.llm.common`).
"""
