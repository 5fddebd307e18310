"""quillstone: a Spark-native fielded text index, ranked search and corpus operators."""
