"""Records as forests: JSON and XML text, protobuf bytes, and Spark rows."""
