"""Analytics over text corpora, retrieval, conversations and completion logs, as plain DataFrame functions."""
