"""Where results go: Kafka topics, JSON files and change streams."""
