"""Code-tree analytics on Spark: source trees as a relation of nodes, analyses as DataFrame plans."""
