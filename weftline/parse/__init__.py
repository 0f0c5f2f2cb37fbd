"""HTML to records: the stages that need a parser, run as Arrow batches."""
