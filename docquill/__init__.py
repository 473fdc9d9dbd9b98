"""docquill: RFC-exact JSON query, location and edit over columns of JSON documents on Spark."""
