"""Community-conversation analytics and text retrieval as Spark queries."""
