"""packetloom: network-traffic analytics as PySpark DataFrame operators."""
