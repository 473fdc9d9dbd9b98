"""Reading and writing JSON documents."""
