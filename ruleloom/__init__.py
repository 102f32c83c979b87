"""Document analytics on Spark: rulemaking documents as DataFrames of text, spans, edits and citations."""
