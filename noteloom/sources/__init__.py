"""Reading and writing: corpora, catalogues, snapshots and reports."""
