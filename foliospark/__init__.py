"""foliospark: document-structure analytics and relational operators on Spark DataFrames."""
