"""What is read and written: dumps, JSON lines, CSV shards, XML parts."""
