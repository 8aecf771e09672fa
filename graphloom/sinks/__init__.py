"""What is written: tables, graphs, documents, and messages with attempts."""
