"""Sources: WARC, JSONL, word lists, decision tables."""
